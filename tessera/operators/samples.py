"""The first few values of many kinds at once, in a stated order, in one pass.

Each kind has a condition and a value; of the rows that meet it, the first k in the order are kept. Every task keeps k for
each kind (Spark's group limit below the window), stripes of tasks keep k of these, and the last step k of all, so no step
holds more than k rows for each kind and task, and rows come out the same however the table is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of tasks whose rows are limited before all meet.
STRIPES = 64


def limited(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= k)


def first_values(df: DataFrame, kinds: dict[str, tuple[Column, Column]], order: list[Column], k: int) -> DataFrame:
    """kind, nth (from 0) and value (as text), for kinds of (condition, value).

    Rows that are equal in ``order`` go by their value. Null values are values too.
    """
    if not kinds:
        return df.sparkSession.createDataFrame([], "kind string, nth int, value string")
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    each = F.array(*[F.when(meets, F.struct(F.lit(kind).alias("kind"), place.alias("place"), value.cast("string").alias("value"))) for kind, (meets, value) in kinds.items()])
    rows = df.select(F.inline(F.filter(each, lambda x: x.isNotNull()))).withColumn("stripe", F.spark_partition_id() % STRIPES)
    some = limited(rows, ["kind", "stripe"], ["place", "value"], k).drop("nth", "stripe")
    return limited(some, ["kind"], ["place", "value"], k).select("kind", (F.col("nth") - 1).alias("nth"), "value")
