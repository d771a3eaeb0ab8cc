"""Quality rules as a ledger: every rule is evaluated once and leaves a bit; policies are masks over the bits.

``measure`` computes the measurements of each text, ``ledger`` adds ``failures`` (bit i set: rule i failed). A policy is
a named, versioned set of rules; ``apply_policy`` and ``ablate`` work on the stored bits alone, without the texts.

A null text counts as empty; it has no words and fails too_few_words. Repeated rows get equal results each. Extra columns
pass through; one with the name of a measurement is replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_rows

#: \x20 and \x09-\x0D: what bytes.split() splits at.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts")])

#: Rules in the order of their bits; a rule names what a rejected text does. The order never changes; new rules go last.
RULES: dict[str, Column | str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 2 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "shouting": "10 * n_shouts > 3 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 30 * n_words",
}
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more, the first included."""
    if len(words) <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n, base = len(ids) - WINDOW + 1, len(known)
    if base**WINDOW < 2**62:
        keys = sum(ids[k : k + n] * base ** (WINDOW - 1 - k) for k in range(WINDOW))
    else:  # number the distinct pairs at each step, so that keys stay small
        keys = ids
        for k in range(1, WINDOW):
            keys = np.unique(keys[: len(ids) - k] * base + ids[k:], return_inverse=True)[1]
    _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = np.flatnonzero(counts[where] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, repeated, 1)
    np.add.at(edges, repeated + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measures(text: str | None) -> tuple:
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    lines = duplicates = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    spaces = sum(map(text.count, SPACES))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), lines, duplicates, repeat_words(words), text.count("!!")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    return map_rows(df, text, MEASURES, lambda: measures)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements and ``failures``, a bit for each rule of RULES."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return measure(df, text).withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def mask(policy: str) -> int:
    names = list(RULES)
    return reduce(or_, (1 << names.index(n) for n in POLICIES[policy]), 0)


def fails(policy: str, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    return entries.filter(~fails(policy))


def ablate(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: texts that fail it, that fail it alone, and that would stay without it."""
    chosen = mask(policy)
    by_mask = entries.groupBy(F.col("failures").bitwiseAND(F.lit(chosen)).alias("m")).count()
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, n in enumerate(RULES) if chosen >> i & 1]))
    each = by_mask.select("m", "count", rows.alias("r")).select("m", "count", "r.*")
    failed = F.col("m").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(failed, F.col("count"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("m") == F.col("bit"), F.col("count"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.sum(F.when((F.col("m") == 0) | (F.col("m") == F.col("bit")), F.col("count"))), F.lit(0)).alias("n_kept_without"),
    )


def verdicts(df: DataFrame) -> DataFrame:
    """The columns of op6."""
    return ledger(df.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails("base").alias("base_failed"), (~fails("v1")).alias("kept"), "n_lines", "n_shouts", "failures",
    )
