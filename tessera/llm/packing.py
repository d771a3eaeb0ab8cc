"""Harmonic packing: pieces of reciprocal-capacity lengths fill bins of a fixed count, independently across workers.

A document is cut into full sequences and a rest; the rest into pieces of exactly CAPACITY // j tokens for the smallest j
that fits, again and again, and a tail of at most TAIL tokens. Class j holds pieces of one length, and each of its bins
takes CAPACITY // length of them, so a bin wastes less than one piece of its class. Which bin a piece lies in follows from
its rank in its class alone: ranks are counted in independent shards and shifted by the shards' counts. A shard holds about
as many pieces as the square root of all (SHARD at least), so neither a shard nor the table of shards grows large.
What is left over, fewer than CAPACITY // length pieces for each of a fixed set of lengths (about 10,000 pieces whatever
the input), is packed first-fit by decreasing length.

A null text counts as empty: a document of the end id alone. Documents with an equal id are packed each by itself; they
are told apart by their contents. Repeated rows are packed each. Long texts are encoded whole; equal lengths are ranked by
doc_id, start and contents. Extra columns are not read by ``pack``; in ``pieces_of`` they stay, but for those with the name
of an output column.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import encoder
from tessera.llm.common import cut_lineage, map_rows

CAPACITY = 2048
END = 1
TAIL = 64
#: Pieces in a shard, at least.
SHARD = 1000
#: Distinct matches in a generation of what a task keeps: with fewer, a quarter of the time went to matches met before.
MATCHES = 450_000

PIECE = T.StructType([
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
])
PIECES = T.StructType([T.StructField("doc_tokens", T.LongType()), T.StructField("pieces", T.ArrayType(PIECE))])
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def piece_lengths(total: int, capacity: int = CAPACITY, tail: int = TAIL) -> Iterator[int]:
    for _ in range(total // capacity):
        yield capacity
    rest = total % capacity
    while rest > tail:
        piece = capacity // -(-capacity // rest)
        yield piece
        rest -= piece
    if rest:
        yield rest


class Cutter:
    """Tuples of PIECES for texts."""

    def __init__(self, path: str, keep_ids: bool):
        self.encoder, self.keep_ids = encoder(path, MATCHES), keep_ids

    def many(self, texts: list[str | None]) -> list[tuple]:
        return [self.cut(ids) for ids in self.encoder.many(texts)]

    def cut(self, ids: np.ndarray) -> tuple:
        ids = np.append(ids, np.uint32(END)).astype("<u4")
        pieces, start = [], 0
        for length in piece_lengths(len(ids)):
            part = ids[start : start + length]
            pieces.append({"start": start, "length": length, "ids_crc32": zlib.crc32(part), "ids": part.tolist() if self.keep_ids else None})
            start += length
        return len(ids), pieces


def pieces_of(df: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece: ``df``'s other columns, start, length, ids_crc32, doc_tokens, and ids (null unless kept)."""
    own = df.drop(*[c for c in PIECE.fieldNames() if c != text])
    cuts = map_rows(own, text, PIECES, lambda: Cutter(path, keep_ids)).drop(text)
    return cuts.select(*[F.col(c) for c in cuts.columns if c != "pieces"], F.inline("pieces"))


def first_fit(pieces: pd.DataFrame) -> pd.DataFrame:
    """Bins for the bounded rest, the longest pieces first."""
    pieces = pieces.sort_values(["length", "doc_id", "start", "doc_tokens", "ids_crc32"], ascending=[False, True, True, True, True], ignore_index=True)
    fill: list[int] = []
    bins, at, first = [], [], 0
    last = 0
    for length in pieces["length"]:
        if length != last:
            first, last = 0, length
        while first < len(fill) and fill[first] + length > CAPACITY:
            first += 1
        if first == len(fill):
            fill.append(0)
        bins.append(first)
        at.append(fill[first])
        fill[first] += length
    return pieces.assign(sequence_id=pieces["base"] + np.array(bins, np.int64), offset=np.array(at, np.int64)).drop(columns="base")


def place(pieces: DataFrame) -> DataFrame:
    """``pieces`` (doc_id, start, length, ids_crc32, doc_tokens; small rows) with sequence_id and offset."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = cut_lineage(pieces.select(*columns))
    # A row for each length: CAPACITY // TAIL + TAIL at most, whatever the input.
    counted = rows.groupBy("length").agg(F.count("*").alias("n"))
    per_shard = F.greatest(F.lit(SHARD), F.sqrt(F.sum("n").over(Window.partitionBy())).cast("long"))
    dealt = F.broadcast(counted.select("length", F.greatest(F.lit(1), F.ceil(F.col("n") / per_shard)).alias("shards")))
    salted = rows.join(dealt, "length").select(*columns, F.pmod(F.xxhash64(*columns), F.col("shards")).alias("salt"))
    shards = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy("length")
    per_bin = F.expr(f"{CAPACITY} div length")
    shards = shards.select(
        "length", "salt",
        (F.sum("n").over(by_length.orderBy("salt")) - F.col("n")).alias("before"),
        (F.floor(F.sum("n").over(by_length) / per_bin)).alias("full"),
    )
    bases = counted.select("length", F.floor(F.col("n") / per_bin).alias("full"))
    bases = bases.select("length", (F.sum("full").over(Window.orderBy("length")) - F.col("full")).alias("base"), F.sum("full").over(Window.partitionBy()).alias("all"))
    starts = shards.join(F.broadcast(bases), "length")
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local"))
    binned = ranked.withColumn("bin", F.expr(f"rank div ({CAPACITY} div length)")).withColumn("slot", F.expr(f"rank % ({CAPACITY} div length)"))
    full = binned.filter("bin < full").select(*columns, (F.col("base") + F.col("bin")).alias("sequence_id"), (F.col("slot") * F.col("length")).alias("offset"))
    left = binned.filter("bin >= full").select(*columns, F.col("all").alias("base"))
    return full.unionByName(left.groupBy("base").applyInPandas(first_fit, PLACED))


def pack(df: DataFrame, path: str) -> DataFrame:
    """The columns of op9."""
    return place(pieces_of(df.select("doc_id", "text"), path))
