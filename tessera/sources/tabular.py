"""CSV and (where openpyxl is there) Excel files, with every cell's missing-value signs made null."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.columns import NUMERIC, quoted


def place_of_rows() -> Column:
    """(file, split, order in the task): the order of rows in files, whatever their splits."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))


def read_text_table(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """A CSV file with all columns as text and missing values as null; with the rows' places if ``place`` names a column."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return raw.select(*[F.when(~quoted(c).isin(fixed.NA_TOKENS), quoted(c)).alias(c) for c in raw.columns], *([place_of_rows().alias(place)] if place else []))


def typed(df: DataFrame, place: str | None = None) -> DataFrame:
    """Text columns as boolean, bigint or double where all values allow it; whole numbers with gaps become doubles.

    The column ``place`` stays as it is.
    """
    names = [c for c in df.columns if c != place]

    def all_of(c: Column, pattern: str) -> Column:
        return F.coalesce(F.bool_and(c.rlike(pattern)), F.lit(False))

    tests = {}
    for i, name in enumerate(names):
        c = quoted(name)
        tests |= {f"b{i}": all_of(c, r"^(True|False|TRUE|FALSE|true|false)$"), f"i{i}": all_of(c, r"^\s*[+-]?\d{1,18}\s*$"), f"f{i}": all_of(c, NUMERIC), f"n{i}": F.count_if(c.isNull()), f"v{i}": F.count(c)}
    row = df.agg(*[e.alias(n) for n, e in tests.items()]).first()

    def cast(i: int, name: str) -> Column:
        c, full = quoted(name), not row[f"n{i}"]
        if not row[f"v{i}"]:
            return c.cast("double").alias(name)
        if row[f"b{i}"] and full:
            return F.lower(c).cast("boolean").alias(name)
        if row[f"i{i}"] and full:
            return F.trim(c).cast("bigint").alias(name)
        return F.trim(c).cast("double").alias(name) if row[f"f{i}"] else c.alias(name)

    return df.select(*[cast(i, n) for i, n in enumerate(names)], *([place] if place else []))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, as text; needs openpyxl on the driver."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("Excel files need openpyxl") from e
    rows = openpyxl.load_workbook(path, read_only=True).worksheets[0].iter_rows(values_only=True)
    names = [str(x) for x in next(rows)]
    return spark.createDataFrame([[None if x is None else str(x) for x in r] for r in rows], ", ".join(f"`{n}` string" for n in names))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension; other extensions are an error."""
    kind = PurePath(path).suffix.lower()
    if kind == ".csv":
        return typed(read_text_table(spark, path))
    if kind in (".xlsx", ".xls"):
        return typed(read_excel(spark, path))
    if kind in (".parquet", ".orc"):
        return spark.read.format(kind[1:]).load(path)
    raise ValueError(f"unsupported file format {kind!r}; use .csv, .xlsx, .xls, .parquet or .orc")


def read_placed_table(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """``read_table`` with one more column, which tells the rows' order in the files, and its name."""
    kind, place = PurePath(path).suffix.lower(), "__place"
    if kind == ".csv":
        return typed(read_text_table(spark, path, place), place), place
    if kind in (".parquet", ".orc"):
        return spark.read.format(kind[1:]).load(path).select("*", place_of_rows().alias(place)), place
    return read_table(spark, path).withColumn(place, F.monotonically_increasing_id()), place
