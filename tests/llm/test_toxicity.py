"""Nearest examples by brute force, and accuracy on the rows that were held out."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.queries import op8_toxicity
from tests.llm.helpers import ODD, documents, empty


def test_block_max_index_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = random.Random(17)
    idf = np.array([rng.uniform(1, 6) for _ in range(12)])
    examples = []
    for i in range(90):
        terms = sorted(rng.sample(range(12), rng.randint(0, 5)))
        examples.append((i, rng.randint(0, 1), terms, [rng.randint(1, 4) for _ in terms]))
    index = toxicity.BlockMaxIndex(examples, idf)
    known = {e[0]: e for e in examples}
    for _ in range(200):
        terms = sorted(rng.sample(range(12), rng.randint(1, 5)))
        unit = toxicity.weights(np.array(terms), np.array([rng.randint(1, 4) for _ in terms], float), idf)
        every = []
        for place, doc in enumerate(index.ids):
            _, _, own, counts = known[doc]
            other = dict(zip(own, toxicity.weights(np.array(own), np.array(counts, float), idf), strict=True))
            cosine = round(float(sum(w * other.get(t, 0) for t, w in zip(terms, unit, strict=True))), 12)
            if cosine:
                every.append((-cosine, place))
        near = index.nearest(np.array(terms), unit, k=7)
        assert [round(-c, 9) for c, _ in near] == [round(c, 9) for c, _ in sorted(every)[:7]]


def test_the_index_is_small():
    """What a worker keeps: a place and a count for each rare posting, common terms in full precision without zeros, compressed examples."""
    rng = np.random.default_rng(29)
    n, n_terms = 600, 20_000
    idf = rng.uniform(1, 6, n_terms)
    examples = []
    for i in range(n):
        terms = np.unique(np.concatenate([rng.integers(0, 256, 30), rng.integers(256, n_terms, 200)])).astype(np.int32)
        examples.append((i, i % 2, terms, rng.integers(1, 5, len(terms)).astype(np.int32)))
    index, total = toxicity.BlockMaxIndex(examples, idf), sum(len(x[2]) for x in examples)
    own = sum(v.nbytes for v in vars(index).values() if isinstance(v, np.ndarray))
    fixed = index.quick.nbytes + index.most.nbytes + index.column.nbytes + index.edges.nbytes + idf.nbytes
    assert own - fixed < 8 * total
    packed = toxicity.packed(examples, idf)
    assert sum(len(x) if isinstance(x, bytes) else getattr(x, "nbytes", 0) for x in packed) < 6 * total + idf.nbytes
    # And it is the same index: rows and cosines in full precision, from what was broadcast as well.
    again = toxicity.loaded(type("Shared", (), {"value": packed}))
    toxicity.INDEXES.clear()
    for x in examples[:20]:
        unit = toxicity.weights(x[2], x[3].astype(float), idf)
        dense = np.zeros(n_terms)
        dense[x[2]] = unit
        every = sorted((-round(float(dense[y[2]] @ toxicity.weights(y[2], y[3].astype(float), idf)), 10) for y in examples))[:5]
        near = index.nearest(x[2], unit, 5)
        assert [-round(c, 10) for c, _ in near] == every and near == again.nearest(x[2], unit, 5)


#: Enough labelled rows (about 3,000 to learn from) for the words of four languages.
TABLES = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    rows = op8_toxicity(spark, TABLES).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    judged = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    high, low = [s for s, y in judged if y], [s for s, y in judged if not y]
    assert len(high) >= 100
    auc = sum((a > b) + (a == b) / 2 for a in high for b in low) / len(high) / len(low)
    assert auc > 0.92
    right = sum((s >= 0.3) == bool(y) for s, y in judged) / len(judged)
    assert right > 0.95
    # Scores are chances: in each band the mean score is near the share of label 1.
    for low, high in ((0, 0.1), (0.1, 0.9), (0.9, 1.01)):
        band = [(s, y) for s, y in judged if low <= s < high]
        mean, share = np.mean([s for s, _ in band]), np.mean([y for _, y in band])
        assert abs(mean - share) < 0.05 + 2 * np.sqrt(mean * (1 - mean) / len(band)), (low, len(band), mean, share)


def test_searches_read_few_examples(spark):
    """Block maxima keep most examples of the given tables from being read, and the nearest are those of a whole scan."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    model, _ = toxicity.fit(docs.select("doc_id", "text"), labels)
    index, vector = toxicity.BlockMaxIndex(model.examples, model.idf), toxicity.Vectorizer(model.terms)
    known = {e[0]: e for e in model.examples}
    texts = [r["text"] for r in docs.orderBy(F.xxhash64("doc_id")).limit(120).collect()]
    vectors = [(np.asarray(t, np.int32), np.asarray(c, float)) for t, c in map(vector, texts) if t]
    whole = np.zeros((len(index.ids), len(model.idf)), np.float32)
    for i, d in enumerate(index.ids):
        whole[i, known[d][2]] = toxicity.weights(known[d][2], known[d][3].astype(float), model.idf)
    for terms, counts in vectors:
        unit = toxicity.weights(terms, counts, model.idf)
        near = index.nearest(terms, unit)
        every = np.sort(whole[:, terms] @ unit)[::-1][: toxicity.K]
        assert np.allclose([c for c, _ in near], every[every > 1e-7], atol=1e-5)
    assert index.of == len(vectors) * len(index.ids) and index.read < 0.5 * index.of


def test_curve():
    rng = np.random.default_rng(23)
    share = rng.uniform(0.02, 0.98, 5000)
    chance = 1 / (1 + np.exp(-(2 * toxicity.logit(share) + 0.5)))
    slope, shift = toxicity.curve_of(share, (rng.uniform(size=5000) < chance).astype(int))
    assert abs(slope - 2) < 0.2 and abs(shift - 0.5) < 0.2
    assert toxicity.curve_of(share, np.zeros(5000)) is None and toxicity.curve_of(share[:0], np.zeros(0)) is None
    assert toxicity.curve_of(share, (share < 0.5).astype(int)) is None  # a falling curve would turn the order round
    apart = toxicity.curve_of(np.array([0.0, 0.0, 1.0, 1.0]), np.array([0, 0, 1, 1]))
    assert all(np.isfinite(apart)) and toxicity.calibrated([(0.0, [1]), (1.0, [])], apart)[0][0] < 0.5


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = documents(spark, [f"{'awful' if i % 3 == 0 else 'nice'} day number {i}" for i in range(200)])
    own = [(i, int(i % 3 == 0)) for i in range(200)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in own]
    score = lambda rows: toxicity.toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).orderBy("doc_id").collect()
    assert score(own) == score(turned)
    by = {r["doc_id"]: r["score"] for r in score(own)}
    assert min(by[i] for i in range(0, 200, 3)) > 0.7 > 0.3 > max(by[i] for i in range(1, 200, 3))


def test_texts_without_marking_terms_are_searched(spark):
    """Words that mark nothing count as well: a text's nearest examples are those that share its words."""
    kinds = ["red apple tree", "blue whale sea", "old stone road"]
    docs = documents(spark, [f"{kinds[i % 3]} number {i}" for i in range(120)])
    labels = docs.select("doc_id", F.expr("cast(doc_id % 40 = 0 as int)").alias("toxic"))
    model, _ = toxicity.fit(docs.select("doc_id", "text"), labels)
    assert {"apple", "whale", "stone", "number"} <= set(model.terms)
    for r in toxicity.toxicity(docs, labels).collect():
        assert len(r["evidence"]) == 3 and {e % 3 for e in r["evidence"]} == {r["doc_id"] % 3}


def test_both_ways_of_scoring_agree(spark):
    docs = documents(spark, [*ODD, *[f"{'awful' if i % 2 else 'nice'} day {i}" for i in range(150)]])
    labels = docs.select("doc_id", (F.col("text").contains("awful")).cast("int").alias("toxic"))
    model, vectors = toxicity.fit(docs.select("doc_id", "text"), labels)
    a = {r["doc_id"]: r["score"] for r in toxicity.score_vectors(vectors, model).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, model).collect()}
    assert a == b


def test_edges(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (0, 0)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    docs = documents(spark, [None, "", "x y", "x y"], ids=[None, 0, 1, 1]).withColumns({"score": F.lit("own"), "terms": F.lit("own"), "evidence": F.lit("own")})
    assert [r["score"] for r in toxicity.toxicity(docs, none).collect()] == [0.0] * 4
    found = toxicity.toxicity(docs, labels.withColumn("text", F.lit("own"))).collect()
    assert len(found) == 4 and all(0 <= r["score"] <= 1 for r in found)
