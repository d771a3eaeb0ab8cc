"""Line deduplication by overlapping windows of three lines.

The windows run over a text's lines that hold a word; other lines stay where they are. A window that equals an earlier
one, in the order of doc_id and then of place, is a repeat; the lines that repeats cover are removed. A run of equal
lines therefore keeps its first line alone. Texts of fewer than WINDOW such lines have no window and stay as they are.

Null texts stay null. Rows with an equal doc_id and text count as one occurrence and get equal results; of rows with an
equal doc_id and other texts, the smaller hash of the text comes first. A null doc_id comes before all others. Long texts
are read whole. Extra columns pass through, whatever their names; one named n_lines or n_removed is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: A line with something other than \x20 and \x09-\x0D.
WORDED = r"[^\x20\x09-\x0D]"


def numbers_of_lines(lines: str) -> Column:
    """Places of the lines that hold a word."""
    return F.expr(f"filter(transform({lines}, (x, i) -> if(x rlike r'{WORDED}', i, -1)), i -> i >= 0)")


def prepared(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__text_hash", F.xxhash64(text)).withColumn("__lines", F.split(text, "\n", -1)).withColumn("__places", numbers_of_lines("__lines"))


def windows(df: DataFrame, text: str = "text") -> DataFrame:
    """occurrence (doc_id, text_hash, at) and 128-bit key (a, b) of each window."""
    first = F.transform("__places", lambda i: F.xxhash64(F.get("__lines", i)))
    second = F.transform("__places", lambda i: F.xxhash64(F.lit("line"), F.get("__lines", i)))
    hashed = prepared(df.select("doc_id", text), text).select("doc_id", "__text_hash", first.alias("h"), second.alias("g")).filter(F.size("h") >= WINDOW)
    at = F.explode(F.sequence(F.lit(0), F.size("h") - WINDOW))
    each = hashed.select("doc_id", "__text_hash", "h", "g", at.alias("at"))
    key = lambda name: F.xxhash64(*[F.get(name, F.col("at") + k) for k in range(WINDOW)])
    return each.select(F.struct("doc_id", F.col("__text_hash").alias("text_hash"), "at").alias("occurrence"), key("h").alias("a"), key("g").alias("b"))


def repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, __text_hash and the places (among worded lines) at which repeats begin."""
    all_windows = windows(df, text)
    # Of each window that occurs at two places or more, the first; counted on the map side before the shuffle.
    first = all_windows.groupBy("a", "b").agg(F.min("occurrence").alias("first"), F.max("occurrence").alias("last")).filter("first < last").drop("last")
    later = all_windows.join(first, ["a", "b"]).filter("occurrence > first")
    return later.groupBy(F.col("occurrence.doc_id").alias("__id"), F.col("occurrence.text_hash").alias("__hash")).agg(F.collect_set("occurrence.at").alias("__at"))


def dedup_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with repeats removed from ``text``, and n_lines and n_removed (worded lines before, and those removed)."""
    kept = [(i, c) for i, c in enumerate(df.columns) if c not in ("n_lines", "n_removed")]
    # Other columns go by number meanwhile, so that no name of theirs meets one of a working column.
    by_number = {i: c if c in ("doc_id", text) else f"own_{i}" for i, c in enumerate(df.columns)}
    made = deduplicated(df.toDF(*by_number.values()), text)
    return made.select(*[F.col(f"`{by_number[i]}`").alias(c) for i, c in kept], "n_lines", "n_removed")


def deduplicated(df: DataFrame, text: str) -> DataFrame:
    own = prepared(df, text)
    found = own.join(repeats(df, text), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    covered = F.expr(f"array_distinct(flatten(transform(__at, i -> slice(__places, i + 1, {WINDOW}))))")
    kept = F.expr("transform(array_except(sequence(0, size(__lines) - 1), __covered), i -> __lines[i])")
    return found.withColumn("__covered", covered).withColumns({
        "n_lines": F.coalesce(F.size("__places"), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.when(F.col("__covered").isNotNull(), F.size("__covered")), F.lit(0)).cast("long"),
        text: F.when(F.col("__covered").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
    })
