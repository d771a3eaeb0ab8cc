"""Merkle manifest: every column against a recursive version on plain lists."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tessera.llm.queries import OP11, op11_merkle_manifest
from tests.against import TABLES, differing
from tests.llm.helpers import DOCUMENTS, ODD, empty, prose


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(values) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root of a list, and for each node the (before, behind) siblings up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            paths[k].append((nodes[run:i], nodes[i + 1 : run + 3]))
            at[k] = i // 3
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = text.replace("\n", "") if even and text is not None else text
        by_source[source].append((doc_id, leaf_of((doc_id, source, lang, n_chars, text)), leaf_of((doc_id, source, lang, n_chars, changed))))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    lower = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        lower[s] = tree([r[1] for r in by_source[s]])
    root, upper = tree([lower[s][0] for s in sources]) if sources else (None, [])
    made = []
    for s, top in zip(sources, upper, strict=True):
        for (doc_id, leaf, other), path in zip(by_source[s], lower[s][1], strict=True):
            node = other
            for before, behind in (*path, *top):
                node = h("".join([*before, node, *behind]))
            proof = h("".join(x for before, behind in (*path, *top) for x in (*before, *behind)))
            made.append((doc_id, leaf, lower[s][0], root, proof, node, node == root))
    return made


def columns(df):
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[4]))


def table(rng, n, sources):
    rows = []
    for i in range(n):
        text = rng.choice([*ODD[:9], prose(rng, rng.choice([1, 9, 60])), "a\nb\n"])
        rows.append((i * 7919 % 100_003, text, rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 5, len(text or "")])))
    return rows


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 200])
def test_by_brute_force(spark, monkeypatch, n):
    """Parts of a few rows, so that most runs lie across parts; one source has a third of the rows."""
    monkeypatch.setattr(merkle, "PART_ROWS", 7)
    rows = table(random.Random(n), n, ["src0"] * 6 + [None, "", "Z", "é", "zz", "src1", "😀", "￿", "a b"])
    found = columns(merkle.check_documents(spark.createDataFrame(rows, DOCUMENTS)))
    assert ordered(found) == ordered(brute(rows))


def test_any_partitioning_gives_the_same(spark, monkeypatch):
    rows = table(random.Random(3), 300, ["hot"] * 4 + [f"s{i}" for i in range(40)])
    df = spark.createDataFrame(rows, DOCUMENTS)
    whole = ordered(columns(merkle.check_documents(df.coalesce(1))))
    monkeypatch.setattr(merkle, "PART_ROWS", 11)
    assert ordered(columns(merkle.check_documents(df.repartition(5)))) == whole == ordered(brute(rows))


def test_a_source_for_each_row_and_one_for_all(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", 9)
    for sources in ([f"s{i}" for i in range(100)], ["one"]):
        rows = [(i, f"text\n{i}", "en", sources[i % len(sources)], 6) for i in range(100)]
        assert ordered(columns(merkle.check_documents(spark.createDataFrame(rows, DOCUMENTS)))) == ordered(brute(rows))


def test_repeated_rows_and_keys(spark, monkeypatch):
    """Rows of one key are dealt to many parts; equal rows have equal leaves, whichever of their places is whose."""
    monkeypatch.setattr(merkle, "PART_ROWS", 5)
    rows = [(None, None, None, None, None)] * 20 + [(7, "same\n", "en", "s", 5)] * 30 + [(7, f"t{i}", "en", "s", 2) for i in range(10)]
    assert ordered(columns(merkle.check_documents(spark.createDataFrame(rows, DOCUMENTS)))) == ordered(brute(rows))


def test_monoid():
    """Merging is associative and commutative, and leaves a logarithm of nodes."""
    rng = random.Random(1)
    sizes = {0: 200, 1: 1, 2: 61, merkle.TOP: 3}
    cells = [(t, i) for t in (0, 1, 2) for i in range(sizes[t])]
    parts = [merkle.Forest({(t, 0): {i: merkle.digest(f"{t} {i}".encode())}}, dict(sizes)).grown() for t, i in cells]
    in_turn = parts[0]
    for k, p in enumerate(parts[1:], 2):
        in_turn = in_turn.merged(p)
        assert sum(map(len, in_turn.nodes.values())) <= 2 * 6 + 2 * 4 + 3, k
    rng.shuffle(parts)
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [parts[i].merged(parts[i + 1])]
    assert parts[0].root() == in_turn.root()
    assert parts[0].nodes == in_turn.nodes and sum(map(len, in_turn.nodes.values())) == 1


def test_siblings_and_other_fields(spark):
    """The general interface: own fields and keys, and siblings from which anybody can fold the root."""
    df = spark.createDataFrame([(f"k{i}", "g" if i % 3 else "h", float(i)) for i in range(40)], "name string, part string, size double")
    found = merkle.manifest(df.withColumnsRenamed({"part": "team"}), ("name", "size"), "name", "team", {"size": F.when(F.col("name") == "k7", F.lit("0"))}, siblings=True).collect()
    assert len(found) == 40 and [r["key"] for r in found if not r["verified"]] == ["k7"]
    for r in found:
        path = tuple((s["before"].encode(), s["behind"].encode()) for s in r["siblings"])
        assert merkle.folded(r["leaf"].encode(), path).decode() == r["root"]
    places = {(r["group"], r["place"]) for r in found}
    assert places == {("g", i) for i in range(26)} | {("h", i) for i in range(14)}


def test_edges(spark):
    assert merkle.check_documents(empty(spark)).count() == 0
    lone = merkle.check_documents(spark.createDataFrame([(5, None, None, "s", None)], DOCUMENTS)).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] == lone["folded_root"] and lone["proof_sha256"] == h("") and lone["verified"]
    clashing = spark.createDataFrame(table(random.Random(2), 30, ["a", "b"]), DOCUMENTS)
    more = clashing.withColumns({c: F.lit("own") for c in ("leaf", "part", "key", "group", "other", "nth", "root", "has_group")})
    assert ordered(columns(merkle.check_documents(more))) == ordered(columns(merkle.check_documents(clashing)))
    long = [(1, "line\n" * 200_000, "en", "s", 1), (2, "x", "en", "s", 1)]
    assert ordered(columns(merkle.check_documents(spark.createDataFrame(long, DOCUMENTS)))) == ordered(brute(long))


def test_query_against_sql(spark):
    assert not differing(op11_merkle_manifest(spark, TABLES), OP11)
