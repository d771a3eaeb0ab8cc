"""Large JSON arrays as the texts of their elements, read in splits.

Spark reads a file in pieces between commas, in splits that end at commas. A first pass sums up each split: whether it ends in
another state (in or out of a string) than it begins with, and by how much brackets change the depth, for either state. From
these few rows follows the state at the start of each split; the second pass cuts the elements out at the commas of depth one.
What stands at the edges of splits is joined. A backslash never stands before such a comma, so no escape is torn apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.logs import stored

QUOTE, BACKSLASH, COMMA = b'"'[0], b"\\"[0], b","[0]
MARKS = np.zeros(256, bool)
MARKS[list(b'"[]{},')] = True
#: What a bracket does to the depth.
STEP = np.zeros(256, np.int64)
STEP[list(b"[{")], STEP[list(b"]}")] = 1, -1


def pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """value (what stands between commas), source_file, and the block at which its split begins."""
    raw = spark.read.option("lineSep", ",").text(paths)
    return raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray, pa.RecordBatch]]:
    """(split, bytes of its next pieces with a comma behind each, the first of these rows)"""
    for batch in batches:
        names, blocks = batch.column("source_file"), batch.column("block").to_numpy()
        codes = names.dictionary_encode().indices.to_numpy()
        starts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a < b:
                values = batch.column("value").slice(a, b - a)
                whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), values), b",")[0].as_py() + b","
                yield (names[a].as_py(), int(blocks[a])), np.frombuffer(whole, np.uint8), batch.slice(a, 1)


def marks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes that no backslash escapes, brackets and commas, which byte each is, and whether the quotes until there are odd."""
    at = np.flatnonzero(MARKS[text])
    found = text[at]
    slashes = text == BACKSLASH
    if slashes.any():
        last_other = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(text))))
        before = np.maximum(at - 1, 0)
        escaped = (found == QUOTE) & (at > 0) & ((before - last_other[before]) % 2 == 1)
        at, found = at[~escaped], found[~escaped]
    return at, found, np.cumsum(found == QUOTE) % 2 == 1


def summed_up(rows: DataFrame) -> DataFrame:
    """A row for each split: whether its quotes are odd, and the change of depth if it begins out of or in a string."""
    types = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("odd", pa.int64()), ("out", pa.int64()), ("in", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, odd, change = None, 0, [0, 0]
        row = lambda: pa.RecordBatch.from_pylist([{"source_file": split[0], "block": split[1], "odd": odd, "out": change[0], "in": change[1]}], types)
        for key, text, _ in runs(batches):
            if key != split:
                if split is not None:
                    yield row()
                split, odd, change = key, 0, [0, 0]
            _, found, flipped = marks(text)
            step, inner = STEP[found], flipped ^ bool(odd)
            change = [change[0] + int(step[~inner].sum()), change[1] + int(step[inner].sum())]
            odd = (odd + int((found == QUOTE).sum())) % 2
        if split is not None:
            yield row()

    return rows.mapInArrow(run, "source_file string, block long, odd long, out long, in long")


def placed(splits: DataFrame) -> DataFrame:
    """Splits with the state that each begins with (``inner``: in a string), and whether their file ends out of all brackets."""
    in_order = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = splits.withColumn("inner", (F.sum("odd").over(in_order) - F.col("odd")) % 2 == 1)
    change = inner.withColumn("change", F.when(F.col("inner"), F.col("in")).otherwise(F.col("out")))
    whole = Window.partitionBy("source_file")
    closed = (F.sum("change").over(whole) == 0) & (F.sum("odd").over(whole) % 2 == 0)
    return change.select("source_file", "block", "inner", (F.sum("change").over(in_order) - F.col("change")).alias("depth"), closed.alias("closed"))


FRAGMENTS = "source_file string, block long, nth int, ended boolean, text string"


def fragments(rows: DataFrame) -> DataFrame:
    """What lies between commas of depth one. nth is 0 for the first of a split, 2 for its last, 1 for those that are whole; ``ended`` by a comma."""
    types = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("nth", pa.int32()), ("ended", pa.bool_()), ("text", pa.string())])

    def made(split: tuple[str, int], texts: list[bytes], nth: list[int], ended: bool) -> pa.RecordBatch:
        n = len(texts)
        values = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64()), pa.array(nth, pa.int32()), pa.array([ended] * n, pa.bool_()), values], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inner, depth, held, n = None, False, 0, [], 0
        for key, text, first in runs(batches):
            if key != split:
                if split is not None:
                    yield made(split, [b"".join(held)], [2], False)
                split, held, n = key, [], 0
                inner, depth = first.column("inner")[0].as_py(), first.column("depth")[0].as_py()
            at, found, flipped = marks(text)
            outside = flipped == inner
            depths = depth + np.cumsum(STEP[found] * outside)
            cuts = at[(found == COMMA) & outside & (depths == 1)].tolist()
            raw, begin = text.tobytes(), [0]
            if cuts:
                begin += [c + 1 for c in cuts]
                texts = [raw[a:b] for a, b in zip(begin[:-1], cuts, strict=True)]
                texts[0] = b"".join([*held, texts[0]])
                yield made(split, texts, [0 if n + k == 0 else 1 for k in range(len(texts))], True)
                held, n = [], n + len(texts)
            held.append(raw[begin[-1] :])
            depth = int(depths[-1])
            inner ^= bool(flipped[-1])
        if split is not None:
            yield made(split, [b"".join(held)], [2], False)

    return rows.mapInArrow(run, FRAGMENTS)


def joined_edges(edges: DataFrame) -> DataFrame:
    """Elements that begin or end a split, put together; the brackets around all are taken off."""
    in_order = Window.partitionBy("source_file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.sum(F.col("ended").cast("int")).over(in_order) - F.col("ended").cast("int")
    parts = F.array_sort(F.collect_list(F.struct("block", "nth", "text")))
    each = edges.withColumn("number", number).groupBy("source_file", "number").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    last = F.max("number").over(Window.partitionBy("source_file"))
    begun = F.when(F.col("number") == 0, F.regexp_replace("text", r"^﻿?\s*\[", "")).otherwise(F.col("text"))
    # Behind the last element stand the bracket and the comma that ``runs`` puts behind each piece.
    found = each.withColumn("last", last).withColumn("text", begun).withColumn("text", F.when(F.col("number") == F.col("last"), F.regexp_replace("text", r"\]\s*,$", "")).otherwise(F.col("text")))
    nothing = (F.col("last") == 0) & ~F.col("text").rlike(r"\S")
    return found.filter(~nothing).select("source_file", "text")


def begins_with_bracket(spark: SparkSession, path: str) -> bool:
    first = spark.read.option("lineSep", ",").text(path).select(F.regexp_extract(F.substring("value", 1, 10_000), r"^﻿?\s*(.)", 1)).first()
    return first is not None and first[0] == "["


def elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file and record (variant) of the elements of files that are JSON arrays; files that are no JSON have none."""
    rows = pieces(spark, paths)
    known = stored(placed(stored(summed_up(rows))))
    found = fragments(rows.join(F.broadcast(known.drop("closed")), ["source_file", "block"]))
    edges = stored(joined_edges(stored(found.filter("nth <> 1"))))
    every = found.filter("nth = 1").select("source_file", "text").unionByName(edges)
    parsed = every.select("source_file", F.try_parse_json("text").alias("record"))
    bad = parsed.filter("record is null").select("source_file").union(known.filter("not closed").select("source_file"))
    wrong = stored(bad.distinct())
    return parsed if wrong.isEmpty() else parsed.join(F.broadcast(wrong), "source_file", "left_anti")
