"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import importlib
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import quality, toxicity
from tests.llm.helpers import ODD, documents
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_packing import check
from tests.llm.test_quality import brute as brute_measures

SMALLEST = "/root/testdata/sf0.001"


def passes(text):
    words, chars, symbols, lines, doubled, repeated = brute_measures(text)
    shouts = (text or "").count("!!")
    return not (words < 10 or 100 * repeated > 20 * words or 10 * symbols > 2 * words or 100 * doubled > 60 * lines or 10 * shouts > 3 * words or chars < 2 * words or chars > 30 * words)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALLEST}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALLEST).cache()
        out.append((docs, made))
        docs = made
    return out


def test_each_stage_on_its_own_input(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "line dedup", "n-gram Jaccard join", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    texts = [{r["doc_id"]: r["text"] for r in before.collect()} for before, _ in stages]
    left = [{r["doc_id"]: r["text"] for r in after.collect()} for _, after in stages[:-1]]
    assert left[0] == {d: t for d, t in texts[0].items() if passes(t)}

    model, _ = toxicity.fit(stages[1][0].select("doc_id", "text"), spark.read.parquet(f"{SMALLEST}/labels.parquet"))
    index, vector = toxicity.BlockMaxIndex(model.examples, model.idf), toxicity.Vectorizer(model.terms)
    assert left[1] == {d: t for d, t in texts[1].items() if index.score(*vector(t))[0] < toxicity.THRESHOLD}

    ids = sorted(texts[2])
    cut = dict(zip(ids, brute_lines([texts[2][i] for i in ids]), strict=True))
    assert left[2] == {i: t for i, (t, n, gone) in cut.items() if not gone or gone < n}

    component = brute_groups(list(texts[3].items()), 5, 80)
    assert left[3] == {d: t for d, t in texts[3].items() if component[d][1] == d}
    assert 0 < len(left[3]) < len(left[2]) <= len(left[1]) <= len(left[0]) < len(texts[0])

    check(stages[4][1].collect(), texts[4], 0.9)


def test_run_gives_the_last_stage(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.run(spark, SMALLEST).select(key).orderBy(key).collect() == stages[-1][1].select(key).orderBy(key).collect()


def test_edges(spark):
    """Stages on nulls, repeated rows and an empty table; clean rows stay."""
    clean = " ".join(f"word{i}" for i in range(40))
    docs = documents(spark, [*ODD, clean, clean, clean + " more", None], ids=[*range(len(ODD)), 100, 100, None, None])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALLEST).cache()
    assert {r["doc_id"] for r in docs.collect()} <= {100, None} and docs.count() >= 1
    none = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SMALLEST).cache()
    assert none.count() == 0


def test_near_duplicates_by_row(spark):
    """A copy without doc_id takes no other row with it; other texts of a doc_id stay."""
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    docs = documents(spark, [text("a"), text("a"), text("b"), text("b"), text("c"), text("d"), text("d")], ids=[1, None, None, None, 7, 7, 7])
    left = corpus_pipeline.near_duplicates(spark, docs, SMALLEST).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in left) == [(0, "b"), (1, "a"), (7, "c"), (7, "d")]


def test_score_needs_no_label_columns(spark):
    docs = documents(spark, [f"{'awful' if i % 2 else 'nice'} day {i}" for i in range(60)])
    labels = docs.select("doc_id", F.col("text").contains("awful").cast("int").alias("toxic"))
    model, _ = toxicity.fit(docs.select("doc_id", "text"), labels)
    assert isinstance(model.idf, np.ndarray) and quality.mask("base") == 3
    assert not any(zlib.crc32(str(e[0]).encode()) % 4 == 2 for e in model.examples)


def test_rest_of_the_library_needs_none_of_this():
    for name in ("tessera.plans.catalog", "tessera.operators.records", "tessera.sources.logs"):
        source = open(importlib.import_module(name).__file__).read()
        assert "tessera.llm" not in source and "corpus_pipeline" not in source


def test_near_duplicates_with_any_names(spark):
    names = ["__first", "__id", "__hash", "__key", "__nth", "__last", "own_1"]
    text = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [text, text, "other " + text[::-1]], ids=[1, 2, None]).withColumns({n: F.concat_ws(" ", F.lit(n), "doc_id") for n in names})
    left = corpus_pipeline.near_duplicates(spark, docs, SMALLEST)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1]
    assert all(r[n] == " ".join([n, *([str(r["doc_id"])] if r["doc_id"] else [])]) for r in left.collect() for n in names)


def test_nothing_but_the_result_is_left(spark):
    """Tables and checkpoints of the stages are deleted; what run() returns stays."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    weight = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file() and "crc" not in f.suffix)
    before = weight()
    found = corpus_pipeline.run(spark, SMALLEST)
    own = Path(found.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    assert weight() - before <= sum(f.stat().st_size for f in own.rglob("*") if f.is_file()) + 1000 and found.count() > 0
