"""Queries over the driver tables, and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Given:
    """An input in SQL that both engines understand; tables are named in braces."""

    def __init__(self, text: str):
        self.text, self.tables = text, sorted(set(re.findall(r"\{(\w+)\}", text)))
        self.sql = re.sub(r"\{(\w+)\}", r"\1", text)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(self.text, **{t: table(spark, sf_dir, t) for t in self.tables})


from tessera.plans import incidents, invoices, quality, records, sources, streams  # noqa: E402, F401  they register their queries
