"""Exact quantiles of any number of columns at once, by distributed selection.

``percentile`` keeps a count for each distinct value of a column in one row. Here no row grows with the data: a sketch
(``percentile_approx``, of a fixed size) brackets the ranks that are sought, a pass counts what lies below, on and between
the brackets, and only the values between them are sorted, once they are few. What the sketch says is a guess that the
counts confirm or refute, so results are exact whatever its error; brackets with too much between them are narrowed by
another sketch of these values alone, each time by a factor of about the sketch's accuracy. All columns and fractions share
each pass. Values that occur very often make a bracket of one value, which needs no sorting.

Nulls don't count. A column without values has null quantiles. Between two ranks the result is linear interpolation.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch meets a rank to within n / ACCURACY.
ACCURACY = 10_000
MARGIN = 4 / ACCURACY
#: Values between brackets that are sorted, at most; and cuts by which wider brackets are narrowed.
INNER = 20_000
CUTS = 256


@dataclass
class Rank:
    """The search for two neighbouring ranks (from 0) of a column."""

    column: str
    low: int
    high: int
    a: float
    b: float
    #: Values that the ranks are known to lie between.
    floor: float
    ceiling: float
    #: Whether there may be so much between a and b that it has to be cut.
    wide: bool
    #: Values before a, on a, between, on b; and cuts of those between.
    counts: tuple[int, int, int, int] | None = None
    cuts: list[float] | None = None

    def at(self, rank: int) -> float | int | None:
        """Its value where the counts give it; else its place among the inner values, if it is there."""
        before, on_a, inner, on_b = self.counts
        if before <= rank < before + on_a:
            return self.a
        if before + on_a + inner <= rank < before + on_a + inner + on_b:
            return self.b
        return None

    def inside(self, rank: int) -> bool:
        before, on_a, inner, _ = self.counts
        return before + on_a <= rank < before + on_a + inner

    @property
    def found(self) -> bool:
        return self.counts is not None and self.at(self.low) is not None and self.at(self.high) is not None

    @property
    def few(self) -> bool:
        return self.counts is not None and self.counts[2] <= INNER and all(self.at(r) is not None or self.inside(r) for r in (self.low, self.high))

    def narrow(self) -> None:
        before, on_a, inner, on_b = self.counts
        if self.low < before:
            self.a, self.b, self.wide = self.floor, self.a, True
        elif self.high >= before + on_a + inner + on_b:
            self.a, self.b, self.wide = self.b, self.ceiling, True
        elif self.cuts is None:
            self.wide = True
        else:
            self.floor, self.ceiling = self.a, self.b
            share = [(r - before - on_a) / inner * CUTS for r in (self.low, self.high)]
            a, b = floor(share[0]) - 2, floor(share[1]) + 3
            self.a = self.cuts[a] if a >= 0 else self.a
            self.b = self.cuts[b] if b <= CUTS else self.b
        self.counts = self.cuts = None


def brackets(fractions: list[float]) -> list[float]:
    return [min(1.0, max(0.0, p + side)) for p in fractions for side in (-MARGIN, MARGIN)]


def first_pass(df: DataFrame, columns: dict[str, Column], fractions: list[float], more: dict[str, dict[str, Column]]) -> dict[str, dict]:
    """n, least, greatest, guess (a bracket for each fraction) and ``more`` of each column, from one aggregation."""
    aggregates = []
    for i, (c, x) in enumerate(columns.items()):
        guess = F.percentile_approx(x, F.array(*[F.lit(p) for p in brackets(fractions)]), ACCURACY)
        own = {"n": F.count(x), "least": F.min(x), "greatest": F.max(x), "guess": guess} | more.get(c, {})
        aggregates += [e.alias(f"{i}_{k}") for k, e in own.items()]
    row = df.agg(*aggregates).first().asDict()
    return {c: {k.split("_", 1)[1]: v for k, v in row.items() if k.startswith(f"{i}_")} for i, c in enumerate(columns)}


def counted(df: DataFrame, columns: dict[str, Column], ranks: list[Rank]) -> None:
    """One pass that counts for all brackets, and cuts those that may have much between them."""
    wide: dict[tuple, bool] = {}
    for r in ranks:
        wide[r.column, r.a, r.b] = wide.get((r.column, r.a, r.b), False) or r.wide
    each, aggregates = list(wide), []
    for i, (c, a, b) in enumerate(each):
        x = columns[c]
        between = (x > a) & (x < b)
        aggregates += [F.count_if(x < a).alias(f"{i}_before"), F.count_if(x == a).alias(f"{i}_a"), F.count_if(between).alias(f"{i}_inner"), F.count_if((x == b) & F.lit(a != b)).alias(f"{i}_b")]
        if wide[c, a, b]:
            aggregates.append(F.percentile_approx(F.when(between, x), F.array(*[F.lit(k / CUTS) for k in range(CUTS + 1)]), ACCURACY).alias(f"{i}_cuts"))
    row = df.agg(*aggregates).first().asDict()
    known = {key: ((row[f"{i}_before"], row[f"{i}_a"], row[f"{i}_inner"], row[f"{i}_b"]), row.get(f"{i}_cuts")) for i, key in enumerate(each)}
    for r in ranks:
        r.counts, r.cuts = known[r.column, r.a, r.b]


def inner_values(df: DataFrame, columns: dict[str, Column], ranks: list[Rank]) -> DataFrame:
    """rank (its number), value, n: the distinct values between the brackets, which are few."""
    each = [F.when((columns[r.column] > r.a) & (columns[r.column] < r.b), F.struct(F.lit(i).alias("rank"), columns[r.column].alias("value"))) for i, r in enumerate(ranks)]
    return df.select(F.inline(F.filter(F.array(*each), lambda x: x.isNotNull()))).groupBy("rank", "value").agg(F.count("*").alias("n"))


def picked(df: DataFrame, columns: dict[str, Column], ranks: list[Rank]) -> dict[tuple[int, int], float]:
    """Values at (number of the search, rank) from the sorted inner values; two at most for each search reach the driver."""
    until = F.sum("n").over(Window.partitionBy("rank").orderBy("value"))
    start = F.get(F.array(*[F.lit(r.counts[0] + r.counts[1]) for r in ranks]), F.col("rank"))
    wanted = [F.get(F.array(*[F.lit(k) for k in ks]), F.col("rank")) for ks in ([r.low for r in ranks], [r.high for r in ranks])]
    placed = inner_values(df, columns, ranks).withColumn("until", start + until)
    hit = [(F.col("until") - F.col("n") <= w) & (w < F.col("until")) for w in wanted]
    rows = placed.select("rank", "value", hit[0].alias("low"), hit[1].alias("high")).filter("low or high").collect()
    found = {}
    for r in rows:
        own = ranks[r["rank"]]
        found |= {(r["rank"], k): r["value"] for k, here in ((own.low, r["low"]), (own.high, r["high"])) if here}
    return found


def selected(df: DataFrame, columns: dict[str, Column], ranks: list[Rank]) -> dict[tuple[str, int], float]:
    """Values by (column, rank)."""
    found: dict[tuple[str, int], float] = {}
    open_ = list(ranks)
    while open_:
        counted(df, columns, open_)
        few = [r for r in open_ if r.few and not r.found]
        inner = picked(df, columns, few) if few else {}
        for i, r in enumerate(few):
            found |= {(r.column, k): r.at(k) if r.at(k) is not None else inner[i, k] for k in (r.low, r.high)}
        for r in open_:
            if r.found:
                found |= {(r.column, k): r.at(k) for k in (r.low, r.high)}
        open_ = [r for r in open_ if not r.found and not r.few]
        for r in open_:
            r.narrow()
    return found


def quantiles(df: DataFrame, columns: dict[str, Column], fractions: list[float], more: dict[str, dict[str, Column]] | None = None) -> dict[str, dict]:
    """For each column n, least, greatest, quantiles (a list) and the aggregates that ``more`` names; expressions are doubles."""
    stats = first_pass(df, columns, fractions, more or {}) if columns else {}
    ranks, places = [], {}
    for c, s in stats.items():
        for i, p in enumerate(fractions if s["n"] else []):
            at = p * (s["n"] - 1)
            low, high = floor(at), min(s["n"] - 1, floor(at) + (at != floor(at)))
            places[c, i] = (at, low, high)
            ranks.append(Rank(c, low, high, s["guess"][2 * i], s["guess"][2 * i + 1], s["least"], s["greatest"], s["n"] * 3 * MARGIN > INNER))
    values = selected(df, columns, ranks)

    def between(c: str, i: int) -> float:
        at, low, high = places[c, i]
        x, y = values[c, low], values[c, high]
        return x if x == y else (high - at) * x + (at - low) * y

    return {c: {k: v for k, v in s.items() if k != "guess"} | {"quantiles": [between(c, i) if s["n"] else None for i in range(len(fractions))]} for c, s in stats.items()}
