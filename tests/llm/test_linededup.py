"""Line dedup against a walk over all texts in order."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessera.llm import linededup
from tessera.llm.queries import OP5, op5_line_dedup
from tests.against import differing
from tests.llm.helpers import ODD, documents, empty

SMALLEST = "/root/testdata/sf0.001"


def brute(texts):
    """Texts (in the order of their ids) with later occurrences of three-line windows removed."""
    seen, out = set(), []
    for text in texts:
        if text is None:
            out.append((None, 0, 0))
            continue
        lines = text.split("\n")
        worded = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for k in range(len(worded) - 2):
            window = tuple(lines[i] for i in worded[k : k + 3])
            gone.update(worded[k : k + 3] if window in seen else [])
            seen.add(window)
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(worded), len(gone)))
    return out


def test_by_brute_force(spark):
    rng = random.Random(11)
    passages = ["\n".join(f"p{k} line {i}" for i in range(rng.randint(3, 7))) for k in range(6)]
    texts = [*ODD]
    for _ in range(150):
        parts = [rng.choice([rng.choice(passages), f"own {rng.random()}", "", " ", "a\na\na\na", "x\ny\nz"]) for _ in range(rng.randint(0, 8))]
        texts.append("\n".join(parts))
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup_lines(documents(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)


def test_query_against_sql(spark):
    assert not differing(op5_line_dedup(spark, SMALLEST), OP5, SMALLEST)


def test_copies_keep_the_first(spark):
    text = "one\ntwo\nthree\nfour"
    found = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(documents(spark, [text] * 40)).collect()}
    assert found[0] == text and {found[i] for i in range(1, 40)} == {""}


def test_edges(spark):
    assert linededup.dedup_lines(empty(spark)).count() == 0
    rows = documents(spark, ["a\nb\nc", "a\nb\nc", None, "a\nb\nc"], ids=[4, 4, None, None]).withColumns({"n_lines": F.lit("own"), "removed": F.lit("own")})
    found = linededup.dedup_lines(rows).collect()
    # The row without an id comes first; both rows of id 4 are one occurrence, and a repeat.
    assert sorted((r["doc_id"] or 0, r["text"] or "-", r["n_removed"]) for r in found) == [(0, "-", 0), (0, "a\nb\nc", 0), (4, "-", 3), (4, "-", 3)]
    assert all(r["removed"] == "own" for r in found)


def test_any_names_of_other_columns(spark):
    """Columns named like the operator's own ones come back as they were."""
    names = ["__at", "__id", "__hash", "__lines", "__places", "__text_hash", "__covered", "own_0", "a`b"]
    rows = documents(spark, ["a\nb\nc", "x\na\nb\nc"]).withColumns({n: F.concat(F.lit(f"{n} "), "doc_id") for n in names})
    found = linededup.dedup_lines(rows).collect()
    assert {(r["doc_id"], r["text"]) for r in found} == {(0, "a\nb\nc"), (1, "x")}
    assert all(r[n] == f"{n} {r['doc_id']}" for r in found for n in names)
