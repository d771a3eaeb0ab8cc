"""Results of Spark against those of SQL on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "/root/testdata/sf0.01"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, Decimal):
        return float(x) if x != x.to_integral_value() else int(x)
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(sql: str, tables: str = TABLES) -> tuple[list[str], Counter]:
    connection = duckdb.connect()
    for file in Path(tables).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}{'/*' if file.is_dir() else ''}')")
    found = connection.execute(sql)
    columns = [d[0] for d in found.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def differing(df, sql: str, tables: str = TABLES) -> str:
    """What differs, in a few words; empty where nothing does."""
    own, fixed = rows_of_spark(df), rows_of_sql(sql, tables)
    if own[0] != fixed[0]:
        return f"columns {own[0]} and {fixed[0]}"
    extra, lacking = own[1] - fixed[1], fixed[1] - own[1]
    return f"{sum(own[1].values())} and {sum(fixed[1].values())} rows; extra {list(extra)[:3]}, lacking {list(lacking)[:3]}" if extra or lacking else ""
