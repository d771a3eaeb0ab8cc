"""The ledger of quality rules against a plain reading of the rules."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.queries import OP6, op6_quality_rules
from tests.against import differing
from tests.llm.helpers import ODD, documents, empty, prose

SMALLEST = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, doubled, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, doubled, len(covered)


def test_measures_by_brute_force():
    rng = random.Random(8)
    texts = [*ODD, *["\n".join(rng.choice(["a b", "c", "# <x>", " ", "a b c d e f g", "d"]) for _ in range(rng.randint(0, 30))) for _ in range(300)], *[prose(rng, 80) for _ in range(50)]]
    for text in texts:
        assert quality.measures(text)[:6] == brute(text), repr(text)


def test_windows_of_many_distinct_words():
    rng = random.Random(9)
    words = [f"w{rng.randrange(9000)}".encode() for _ in range(20_000)] * 2
    assert quality.repeat_words(words) == len(words)
    assert quality.repeat_words([b"a"] * 5) == 0 and quality.repeat_words([b"a"] * 6) == 6


def test_query_against_sql(spark):
    assert not differing(op6_quality_rules(spark, SMALLEST), OP6, SMALLEST)


def test_policies_and_ablation(spark):
    rng = random.Random(10)
    docs = documents(spark, [*ODD, *[prose(rng, n) for n in range(40)], "a b c d e " * 30, "# " * 40, "same\n" * 40])
    ledger = quality.ledger(docs).cache()
    rows = ledger.collect()
    for policy in quality.POLICIES:
        mask = quality.mask(policy)
        assert {r["doc_id"] for r in quality.apply_policy(ledger, policy).collect()} == {r["doc_id"] for r in rows if not r["failures"] & mask}
        ablation = {r["rule"]: r for r in quality.ablate(ledger, policy).collect()}
        assert set(ablation) == set(quality.POLICIES[policy])
        for rule, r in ablation.items():
            bit = quality.mask(policy) & (1 << list(quality.RULES).index(rule))
            kept = [x["failures"] & mask for x in rows]
            assert (r["n_failed"], r["n_only"], r["n_kept_without"]) == (sum(bool(k & bit) for k in kept), sum(k == bit for k in kept), sum(k in (0, bit) for k in kept))


def test_edges(spark):
    assert quality.verdicts(empty(spark)).count() == 0 and quality.ablate(quality.ledger(empty(spark)), "v1").count() == 0
    clashing = documents(spark, [None, "x"]).withColumns({"n_words": F.lit("own"), "failures": F.lit("own")})
    assert all(r["failures"] & 1 for r in quality.ledger(clashing).collect())
    nulls = quality.verdicts(documents(spark, [None, None], ids=[None, None])).collect()
    assert nulls[0] == nulls[1] and nulls[0]["base_failed"] and not nulls[0]["kept"]
