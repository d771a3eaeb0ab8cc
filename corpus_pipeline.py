"""A training corpus from ``documents`` in stages; each works on all rows that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns documents with the columns of ``docs``; the last returns packed pieces. The
output of a stage is deleted once the next one is stored, and so are the tables that a stage writes in between.

Null texts have too few words, so the quality rules reject them; empty tables give empty results. Rows without doc_id take
part in all stages. Repeated rows go through the first two stages each, line dedup treats them as one occurrence, and of
near duplicates, repeated rows included, one row is left: that with the smallest doc_id. Long texts are read whole. Extra
columns pass through all stages but the last.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import jaccard, linededup, packing, quality, toxicity
from tessera.llm.common import checkpoint_folder, remove, scratch, table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Shingles and similarity of near duplicates.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy."""
    return quality.apply_policy(quality.ledger(docs), "v1").select(docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose share of toxic votes is below the threshold, learnt from the labels of documents that are left."""
    model, _ = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), calibrate=False)
    return toxicity.score_texts(docs, model).filter(F.col("score") < toxicity.THRESHOLD).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of three lines or more that an earlier one has; those that are all repeats go."""
    cut = linededup.dedup_lines(docs).filter("n_removed = 0 or n_removed < n_lines")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; of repeated rows one.

    Rows with an equal doc_id and text are one document. Rows without doc_id, and further texts of a doc_id, take part
    under a key from a hash and come after all numbered documents.
    """
    # Other columns go by number meanwhile, so that no name of theirs meets one of a working column.
    by_number = {c: c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(docs.columns)}
    hashed = docs.toDF(*by_number.values()).withColumn("__hash", F.xxhash64("text"))
    several = written(hashed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("__hash").alias("__first"), F.max("__hash").alias("__last")).filter("__first < __last").select(F.col("doc_id").alias("__id"), "__first"))
    # Rows without doc_id need no lookup, and would all meet in one task.
    with_id = hashed.filter("doc_id is not null").join(several, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    looked_up = with_id.unionByName(hashed.filter("doc_id is null").withColumn("__first", F.lit(None).cast("long")))
    numbered = F.col("doc_id").isNotNull() & (F.col("__first").isNull() | (F.col("__first") == F.col("__hash")))
    other = F.xxhash64("doc_id", "__hash").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    keyed = looked_up.withColumn("__key", F.when(numbered, F.col("doc_id")).otherwise(other))
    groups = jaccard.groups(keyed.select(F.col("__key").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    gone = groups.filter("component_id != doc_id").select(F.col("doc_id").alias("__key")).distinct()
    left = keyed.join(gone, "__key", "left_anti")
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__hash"))
    return left.withColumn("__nth", nth).filter("__nth = 1").select(*[F.col(own).alias(c) for c, own in by_number.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", pack),
]
#: Tokens can't be had from SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
