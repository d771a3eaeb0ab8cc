"""PartEnum join against all pairs."""

from __future__ import annotations

import random
from pathlib import Path
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard
from tessera.llm.common import FREED_SHUFFLES
from tessera.llm.queries import OP7, op7_ngram_jaccard
from tests.against import differing
from tests.llm.helpers import ODD, documents, empty

SMALLEST = "/root/testdata/sf0.001"


def shingles(text, n):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, percent):
    """doc_id -> (set size, component) from all pairs."""
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(rng, groups, size, length):
    """Groups of texts that differ in a few words from their predecessors, so that chains arise near the threshold."""
    texts = []
    for _ in range(groups):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(3, length))]
        for _ in range(rng.randint(1, size)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            if rng.random() < 0.4:
                words = own
            texts.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in own))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_by_brute_force(spark, n, percent):
    rng = random.Random(12 + n)
    texts = [*ODD, *corpus(rng, 60, 12, 160), "a b", "A  B", "a b c", "a", "a"]
    ids = rng.sample(range(10_000), len(texts))
    found = jaccard.groups(documents(spark, texts, ids), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(list(zip(ids, texts, strict=True)), n, percent)


def test_large_buckets_go_by_hubs(spark, monkeypatch):
    """One group of hundreds of near copies: every bucket is a large one, and links far from the hub must be found."""
    monkeypatch.setattr(jaccard, "SMALL", 3)
    rng = random.Random(15)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        own = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 5])):
            own[at] = rng.choice(["p", "q", "r"]) + str(at)
        texts.append(" ".join(own))
    found = jaccard.groups(documents(spark, texts), 3, 90).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(list(enumerate(texts)), 3, 90)


def test_signatures_meet_for_every_similar_pair():
    """The promise of PartEnum itself: sets at the threshold share a signature."""
    rng = random.Random(16)
    mixed = lambda xs: jaccard.mix(jaccard.np.array(sorted(xs), jaccard.np.uint64) + jaccard.np.uint64(1))
    for percent in (80, 90):
        for _ in range(400):
            size = rng.randint(1, 300)
            common = rng.sample(range(100_000), size)
            extra = rng.randint(0, max(0, size * (100 - percent) // percent))
            split = rng.randint(0, extra)
            a, b = set(common) | {200_000 + i for i in range(split)}, set(common) | {300_000 + i for i in range(extra - split)}
            assert 100 * len(a & b) >= percent * len(a | b)
            if len(a) == len(b) == len(a | b):
                continue  # equal sets are one class
            for order in (1, -1):  # whichever signatures count as the frequent ones
                kept = [{(place, x) for place, spare, found in jaccard.sign(jaccard.np.sort(mixed(s)), percent) for x in sorted(found.tolist(), key=lambda x: order * x)[: len(found) - spare]} for s in (a, b)]
                assert kept[0] & kept[1]


def test_no_signature_is_of_nothing():
    """Sets whose elements lie in few partitions sign finer ones; unrelated sets share no signature."""
    rng = jaccard.np.random.default_rng(17)
    for percent in (80, 90):
        seen = set()
        for size in [*range(1, 60), 200, 700, 3000]:
            for place, spare, found in jaccard.sign(jaccard.np.unique(rng.integers(0, 2**63, size, dtype=jaccard.np.uint64)), percent):
                assert 0 <= spare < len(found)
                own = {(place, x) for x in found.tolist()}
                assert not own & seen
                seen |= own


def test_similar_sets_crowded_into_few_partitions_meet():
    """All elements in one partition: every other signature is empty, so the finer steps must find the pair."""
    for percent in (80, 90):
        step = (3 if percent >= jaccard.DENSE else 2) * jaccard.groups_of(5, percent) << 20
        base = jaccard.np.arange(1, 41, dtype=jaccard.np.uint64) * jaccard.np.uint64(step) + jaccard.np.arange(40, dtype=jaccard.np.uint64)
        other = base[1:]
        kept = [{(place, x) for place, spare, found in jaccard.sign(s, percent) for x in sorted(found.tolist())[: len(found) - spare]} for s in (base, other)]
        assert kept[0] & kept[1] and max(p & 31 for p, _ in kept[0]) > 0


def test_no_large_bucket_of_unrelated_texts(spark):
    """Whatever shares a signature with many others shares shingles with them, at the pipeline's settings too."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    whole = jaccard.cut_lineage(jaccard.signed(docs, 5, 80))
    entries = jaccard.rare_signatures(jaccard.representatives(whole))
    sized = entries.groupBy("signature").agg(F.min("u").alias("first"), F.count("*").alias("n")).filter(F.col("n") > jaccard.SMALL)
    pairs = entries.join(sized, "signature").filter("u != first").select("u", "first").distinct().collect()
    chosen = {i for r in pairs for i in (r["u"], r["first"])}
    texts = {r["doc_id"]: shingles(r["text"], 5) for r in docs.filter(F.col("doc_id").isin(sorted(chosen))).collect()}
    assert all(texts[r["u"]] & texts[r["first"]] for r in pairs)


def test_query_against_sql(spark):
    assert not differing(op7_ngram_jaccard(spark, SMALLEST), OP7, SMALLEST)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 105), (105, 102)], "u long, v long")
    found = {r["node"]: r["component"] for r in jaccard.components(links).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {105: 100, 102: 100}


def test_edges(spark):
    assert jaccard.groups(empty(spark)).count() == 0
    rows = documents(spark, ["a b c d e f", "a b c d e f", None, "", "a b c d e f"], ids=[5, 5, 9, None, None]).withColumns({"n_shingles": F.lit("own"), "component_id": F.lit("own")})
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.groups(rows).collect() if r["component_id"] is not None)
    assert found == [(0, 2, 5), (5, 2, 5), (5, 2, 5), (9, 0, 9)]
    assert jaccard.groups(rows).count() == 5


def test_large_buckets_of_a_round_share_a_hub(spark, monkeypatch):
    """Buckets of different elements with a common member: that is the hub of all, not each bucket's nearest set."""
    monkeypatch.setattr(jaccard, "SMALL", 3)
    rows = [(0, e, u, True, 100, apart, 90) for e in range(6) for u, apart in ((99, 80), (10 * e + 1, 60), (10 * e + 2, 70), (10 * e + 3, 75))]
    buckets = spark.createDataFrame(rows, "hub long, element long, u long, far boolean, size long, apart long, room long")
    pairs = jaccard.next_pairs(buckets, 80).collect()
    assert {(r["u"], r["hub"], r["large"]) for r in pairs} == {(10 * e + k, 99, True) for e in range(6) for k in (1, 2, 3)}


def test_shuffle_files_go_with_their_action(spark):
    """The rounds' shuffles do not add up on the disk, and the session's setting is as before."""
    docs = documents(spark, corpus(random.Random(21), 20, 4, 80))
    before = spark.conf.get(FREED_SHUFFLES)
    top = Path(spark.sparkContext._temp_dir).parents[1]
    files = lambda: set(top.glob("blockmgr-*/*/shuffle_*.data"))
    held = files()
    found = jaccard.groups(docs, 3, 90)
    assert not files() - held and spark.conf.get(FREED_SHUFFLES) == before
    assert found.count() == docs.count()


def far_copies(rng, many, chains=0.1):
    """Copies of one text, each with many edits of its own at places that others edit too, and some copies of these."""
    base, texts = [f"w{i}" for i in range(150)], []
    for _ in range(many):
        if texts and rng.random() < chains:
            own = rng.choice(texts).split()
            own[rng.randrange(len(own))] = f"y{rng.randrange(9)}"
        else:
            gone = set(rng.sample(range(150), rng.choice([2, 12, 14, 16])))
            own = [w for i, w in enumerate(base) if i not in gone]
        texts.append(" ".join(own))
    return texts


def test_copies_far_from_each_other_make_no_rounds(spark, monkeypatch):
    """What a group stores does not grow with its pairs: no meetings on single differences, a few rows for each copy."""
    monkeypatch.setattr(jaccard, "meetings", lambda *_: pytest.fail("a small group goes by rounds"))
    stored = []
    monkeypatch.setattr(jaccard, "written", lambda df, f=jaccard.written: stored.append((made := f(df)).count()) or made)
    texts = far_copies(random.Random(31), 300)
    found = jaccard.groups(documents(spark, texts), 5, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(list(enumerate(texts)), 5, 80)
    assert sum(stored) < 20 * len(texts)


@pytest.mark.parametrize("blocks", [1 << 30, 0])
def test_groups_of_many_blocks_and_by_rounds(spark, monkeypatch, blocks):
    """Pairs within and across blocks are found, and the rounds of groups too large for blocks find the same."""
    for name, value in (("SMALL", 3), ("BLOCK", 2500), ("BLOCKS", blocks)):
        monkeypatch.setattr(jaccard, name, value)
    texts = [*far_copies(random.Random(32), 110), *far_copies(random.Random(33), 60, 0.8)]
    found = jaccard.groups(documents(spark, texts), 5, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(list(enumerate(texts)), 5, 80)


def test_alike_sets_of_a_block_make_a_link_each(spark):
    """All pairs of a hundred sets are similar: 99 links, none among those near the hub."""
    texts = [" ".join([*(f"w{i}" for i in range(200)), f"x{k}"]) for k in range(100)]
    packed = [jaccard.zstandard.ZstdCompressor().compress(t.encode()) for t in texts]
    batch = jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array(range(100), jaccard.pa.int64()), jaccard.pa.array(packed)], names=["doc_id", "packed"])
    sets = jaccard.pa.Table.from_batches(list(jaccard.with_parity(5, iter([batch]))))
    for near in (0, 40):
        own = {"size": [197] * 100, "block": [k % 2 for k in range(100)], "far": [k >= near for k in range(100)]}
        table = sets
        for name, values in own.items():
            table = table.append_column(name, jaccard.pa.array(values))
        linked = jaccard.link_blocks(5, 80, table)
        assert linked.num_rows == 99 - max(0, near - 1)
