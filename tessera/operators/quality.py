"""Quality of tabular data: missing values, duplicates, validity, distributions, outliers, score, cleaning.

All statistics of a kind come from one aggregation over the table, with a partial step before its shuffle. Column names
and types steer which expressions are built; rows never come to the driver but for bounded samples and one row of
statistics for each column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fixed
from tessera.functions.columns import NUMERIC, date, is_number, missing_as_null, number, quoted, timestamp
from tessera.operators.quantiles import quantiles
from tessera.operators.samples import first_values
from tessera.session import shared_folder

SNIFFED, SAMPLES = 100, 10


def turned(df: DataFrame, aggregates: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregation of many columns, as a row for each: ``aggregates`` has expressions by statistic, by column."""
    names = list(aggregates)
    stats = list(next(iter(aggregates.values())))
    one = df.agg(*[aggregates[c][s].alias(f"{i}_{s}") for i, c in enumerate(names) for s in stats])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{s}").alias(s) for s in stats]) for i, c in enumerate(names)])
    return one.select(F.inline(rows))


def missing(df: DataFrame) -> DataFrame:
    """column, missing, total"""
    df = missing_as_null(df)
    return turned(df, {c: {"missing": F.count_if(quoted(c).isNull()), "total": F.count(F.lit(1))} for c in df.columns})


def fingerprint(df: DataFrame) -> list[Column]:
    """128 bits of a row, as two columns. Equal rows have equal ones; nulls are equal, and tell where they stand."""
    cells = [*[quoted(c) for c in df.columns], *[quoted(c).isNull() for c in df.columns]]
    return [F.xxhash64(*cells), F.xxhash64(F.lit("row"), *cells)]


def repeated(df: DataFrame) -> DataFrame:
    """a, b and n of the fingerprints that several rows have; only fingerprints are shuffled, counted on the map side."""
    a, b = fingerprint(df)
    return df.select(a.alias("a"), b.alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1")


def split_by_repeats(df: DataFrame, several: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose fingerprint no other row has, and the others. ``several``: what ``repeated`` gives for ``df``, where it is known."""
    a, b = fingerprint(df)
    several = (repeated(df) if several is None else several).select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    same = (a == F.col("__a")) & (b == F.col("__b"))
    return df.join(several, same, "left_anti"), df.join(several, same, "left_semi")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows and duplicates: rows beyond the first of each distinct row. Nulls are equal.

    Whole rows are compared only among those with a fingerprint that comes again.
    """
    df = missing_as_null(df)
    groups = split_by_repeats(df)[1].groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*")).toDF(*[f"c{i}" for i in range(len(df.columns))], "n")
    parts = df.select(F.lit(1).alias("n_rows"), F.lit(0).alias("duplicates")).unionByName(groups.select(F.lit(0).alias("n_rows"), (F.col("n") - 1).alias("duplicates")))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "duplicates")])


def distinct_rows(df: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """One of each; only rows whose fingerprint comes again are compared as a whole."""
    once, again = split_by_repeats(df, several)
    return once.unionByName(again.dropDuplicates())


def stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder, so that it is worked out once."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid4().hex}"
    df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.parquet(path)
    return df.sparkSession.read.parquet(path).toDF(*df.columns)


def stored_distinct_rows(df: DataFrame) -> DataFrame:
    """``distinct_rows`` for several passes: the table itself if no fingerprint comes again, else a stored one."""
    several = stored(repeated(df))
    if several.isEmpty():
        return df
    found = distinct_rows(df, several)
    # Columns without a type can't be stored.
    return found if any(isinstance(f.dataType, T.NullType) for f in df.schema) else stored(found)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, non_null, nulls, distinct_values, by one shuffle of distinct (column, value) pairs."""
    df = missing_as_null(df)
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns]))
    counted = df.select(pairs).groupBy("column", "value").agg(F.count("*").alias("n"))
    found = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null")
    absent = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls")
    return counted.groupBy("column").agg(found, absent, F.count("value").alias("distinct_values"))


def is_id_name(name: str) -> bool:
    return re.search(fixed.ID_NAME, name, re.I) is not None


def duplicate_ids(df: DataFrame) -> DataFrame:
    """column, duplicates of the id column with the most repeated values; the first in order among equals; none if no repeats."""
    ids = [c for c in df.columns if is_id_name(c)]
    if not ids:
        return df.sparkSession.createDataFrame([], "column string, duplicates long")
    place = F.array_position(F.array(*[F.lit(c) for c in ids]), F.col("column"))
    found = distinct_counts(df, ids).select("column", (F.col("non_null") - F.col("distinct_values")).alias("duplicates"), place.alias("place"))
    return found.filter("duplicates > 0").orderBy(F.desc("duplicates"), "place").limit(1).select("column", "duplicates")


DISTRIBUTION = "column string, n long, mean double, median double, std double, least double, greatest double, q1 double, q3 double"


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, median, std, least, greatest, q1, q3; quantiles exact, by linear interpolation."""
    df = missing_as_null(df)
    x = {c: quoted(c).cast("double") for c in columns}
    found = quantiles(df, x, [0.25, 0.5, 0.75], {c: {"mean": F.avg(e), "std": F.stddev_samp(e)} for c, e in x.items()})
    rows = [(c, s["n"], s["mean"], s["quantiles"][1], s["std"], s["least"], s["greatest"], s["quantiles"][0], s["quantiles"][2]) for c, s in found.items()]
    return df.sparkSession.createDataFrame(rows, DISTRIBUTION)


def bounds_of(rows: list) -> list[tuple[str, float, float]]:
    """Name and interquartile bounds of the columns of ``distribution`` with four values at least."""
    return [(r["column"], r["q1"] - 1.5 * (r["q3"] - r["q1"]), r["q3"] + 1.5 * (r["q3"] - r["q1"])) for r in rows if r["n"] >= 4]


def bounds(df: DataFrame, columns: list[str]) -> list[tuple[str, float, float]]:
    """``bounds_of`` a table; a row for each column comes to the driver."""
    return bounds_of(distribution(df, columns).collect())


def outliers(df: DataFrame, columns: list[str], found: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """column, lower, upper, outliers; the bounds are literals of the second pass, so that nothing is joined."""
    found = bounds(df, columns) if found is None else found
    if not found:
        return df.sparkSession.createDataFrame([], "column string, lower double, upper double, outliers long")
    x = {c: quoted(c).cast("double") for c, _, _ in found}
    return turned(missing_as_null(df), {c: {"lower": F.max(F.lit(lo)), "upper": F.max(F.lit(hi)), "outliers": F.count_if((x[c] < lo) | (x[c] > hi))} for c, lo, hi in found})


def by_values(df: DataFrame) -> list[Column]:
    """An order of rows that no partitioning changes, for tables that have no order of their own."""
    return [F.xxhash64(*[quoted(c) for c in df.columns])]


def outlier_checks(found: list[tuple[str, float, float]]) -> dict[str, tuple[Column, Column]]:
    x = {c: quoted(c).cast("double") for c, _, _ in found}
    return {c: ((x[c] < lo) | (x[c] > hi), x[c]) for c, lo, hi in found}


def outlier_samples(df: DataFrame, columns: list[str], order: list[str], n: int = SAMPLES) -> DataFrame:
    """column, nth, value: the first ``n`` outliers of each column, in the order of ``order``."""
    df = missing_as_null(df)
    found = first_values(df, outlier_checks(bounds(df, columns)), [quoted(o) for o in order], n)
    return found.select(F.col("kind").alias("column"), "nth", F.col("value").cast("double").alias("value"))


def suspicious(counts: DataFrame) -> DataFrame:
    """column and reasons of the columns of ``distinct_counts`` that look wrong."""
    total = F.col("non_null") + F.col("nulls")
    reasons = F.filter(
        F.array(
            F.when(F.col("nulls") > 0.8 * total, F.lit("mostly missing")),
            F.when((F.col("distinct_values") <= 1) & (F.col("non_null") > 0), F.lit("constant")),
            F.when((F.col("distinct_values") > 0.95 * F.col("non_null")) & (F.col("distinct_values") > 50), F.lit("very high cardinality")),
        ),
        lambda x: x.isNotNull(),
    )
    return counts.select("column", reasons.alias("reasons")).filter(F.size("reasons") > 0)


# Validity.


def invalid_email(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(fixed.EMAIL)


def invalid_number(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(NUMERIC)


def invalid_date(c: Column) -> Column:
    return c.isNotNull() & F.coalesce(date(c).cast("timestamp"), timestamp(c)).isNull()


def invalid_counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """column and invalid, for conditions by column."""
    return turned(df, {c: {"invalid": F.count_if(bad)} for c, bad in checks.items()})


def fault_samples(df: DataFrame, checks: dict[str, Column], order: list[Column] | None = None, n: int = SAMPLES) -> DataFrame:
    """column, nth, value: the first ``n`` bad values of each column that ``checks`` has a condition for, as text."""
    found = first_values(df, {c: (bad, quoted(c)) for c, bad in checks.items()}, by_values(df) if order is None else order, n)
    return found.withColumnRenamed("kind", "column")


# Types.


def email_shares(df: DataFrame, columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """column, looked_at and share of the first values (SNIFFED at most, without nulls) that have the form of mail addresses."""
    head = first_values(df, {c: (quoted(c).isNotNull(), quoted(c)) for c in columns}, by_values(df) if order is None else order, SNIFFED)
    return head.groupBy(F.col("kind").alias("column")).agg(F.count("*").alias("looked_at"), F.avg(F.col("value").rlike(fixed.EMAIL).cast("double")).alias("share"))


def kind(df: DataFrame, c: str, non_null: int, distinct: int, emails: bool = False) -> str:
    """datetime, boolean, float, integer, email, datetime (string), phone, categorical or text."""
    of = df.schema[c].dataType
    if isinstance(of, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(of, T.BooleanType):
        return "boolean"
    if is_number(df, c):
        return "float" if isinstance(of, (T.FloatType, T.DoubleType, T.DecimalType)) else "integer"
    for name, pattern in (("email", fixed.EMAIL_NAME), ("datetime (string)", fixed.DATE_NAME), ("phone", fixed.PHONE_NAME)):
        if re.search(pattern, c, re.I) or name == "email" and emails:
            return name
    return "categorical" if non_null and distinct / non_null < 0.05 else "text"


# Score.


@dataclass
class Totals:
    rows: int
    columns: int
    missing: int = 0
    duplicate_rows: int = 0
    duplicate_ids: int = 0
    emails: int = 0
    dates: int = 0
    numbers: int = 0
    outliers: int = 0
    suspicious: int = 0

    @property
    def cells(self) -> int:
        return self.rows * self.columns


# What each kind of fault costs: base of the share, factor, most.
PENALTIES = {
    "missing": ("cells", 100, 25), "duplicate_rows": ("rows", 100, 15), "duplicate_ids": ("rows", 100, 10), "emails": ("cells", 200, 10),
    "dates": ("cells", 200, 10), "numbers": ("cells", 200, 10), "outliers": ("cells", 100, 10), "suspicious": ("columns", 30, 10),
}


def score(totals: Totals) -> float:
    """From 0 to 100, to two places."""
    if not totals.cells:
        return 0.0
    lost = sum(min(float(most), getattr(totals, fault) / getattr(totals, base) * factor) for fault, (base, factor, most) in PENALTIES.items())
    return round(max(0.0, 100.0 - lost), 2)


# Cleaning.


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and value: the commonest value of each text column, the smallest of equals; values are counted before they meet."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in columns]))
    counts = df.select(pairs).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))


def clean(df: DataFrame) -> DataFrame:
    """Distinct rows, with missing numbers replaced by the median and missing text by the commonest (the smallest of equals).

    Medians and commonest values are sought only for columns that lack some. Numbers come out as doubles all the same.
    """
    distinct = stored_distinct_rows(missing_as_null(df))
    numbers = [c for c in df.columns if is_number(df, c)]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not numbers and not texts:
        return distinct
    total, *present = distinct.agg(F.count(F.lit(1)), *[F.count(quoted(c)) for c in numbers + texts]).first()
    known = dict(zip(numbers + texts, present, strict=True))
    gaps = {c for c, n in known.items() if 0 < n < total}
    values: dict[str, float | str] = {c: 0.0 for c in numbers if known[c] == total and total}
    values |= {c: s["quantiles"][0] for c, s in quantiles(distinct, {c: quoted(c).cast("double") for c in numbers if c in gaps}, [0.5]).items()}
    if texts := [c for c in texts if c in gaps]:
        values |= {r["column"]: r["value"] for r in modes(distinct, texts).collect()}
    return distinct.select(*[F.coalesce(quoted(c), F.lit(values[c])).alias(c) if values.get(c) is not None else quoted(c) for c in distinct.columns])


# The whole profile.


@dataclass
class Profile:
    rows: int
    columns: dict[str, dict]
    totals: Totals
    duplicate_id: tuple[str, int] | None
    faults: dict[str, dict[str, int]]
    suspicious: dict[str, list[str]]
    score: float
    recommendations: list[str] = field(default_factory=list)
    samples: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def document(self, cleaned_file: str | None = None) -> dict:
        """The stored form: plain values, rounded to four places."""
        places = lambda x: round(x, 4) if isinstance(x, float) else x
        shape = {"mean": "mean", "median": "median", "std": "std", "least": "min", "greatest": "max", "q1": "q1", "q3": "q3"}
        spread = {c: {own: places(x[k]) for k, own in shape.items()} for c, x in self.columns.items() if x.get("n")}
        bad = lambda kind: {c: {"count": n, "samples": self.samples.get(kind, {}).get(c, [])} for c, n in self.faults[kind].items()}
        far = {c: found | {"lower_bound": places(self.columns[c]["lower"]), "upper_bound": places(self.columns[c]["upper"])} for c, found in bad("outliers").items()}
        profiles = [{"name": c, "type": x["kind"], "non_null": x["non_null"], "missing": x["nulls"], "distinct": x["distinct_values"]} | ({"distribution": spread[c]} if c in spread else {}) for c, x in self.columns.items()]
        repeats = {"column": self.duplicate_id[0], "count": self.duplicate_id[1]} if self.duplicate_id else {}
        issues = {"missing_values": {"total": self.totals.missing, "by_column": self.faults["missing"]}, "duplicate_rows": self.totals.duplicate_rows, "duplicate_ids": repeats}
        issues |= {"invalid_emails": bad("emails"), "invalid_dates": bad("dates"), "invalid_numerics": bad("numbers"), "outliers": far}
        return {
            "quality_score": self.score, "rows": self.rows, "columns": self.totals.columns, "column_profiles": profiles, "issues": issues,
            "distributions": spread, "suspicious_columns": self.suspicious, "recommendations": self.recommendations, "cleaned_file": cleaned_file,
        }


def issue_frame(spark, found: Profile) -> DataFrame:
    """kind, column, count, lower, upper and samples of all faults of a profile, as a table."""
    rows = [(kind, c, n, found.columns.get(c, {}).get("lower") if kind == "outliers" else None, found.columns.get(c, {}).get("upper") if kind == "outliers" else None, found.samples.get(kind, {}).get(c, [])) for kind, own in found.faults.items() for c, n in own.items()]
    return spark.createDataFrame(rows, "kind string, column string, count long, lower double, upper double, samples array<string>")


def recommendations(found: Profile) -> list[str]:
    """What to do about the faults, in a fixed order of kinds."""
    of, rows, faults = fixed.QUALITY_ADVICE, found.rows, found.faults
    said = [of["missing"].format(c, n, round(100 * n / rows, 2)) for c, n in faults["missing"].items()]
    said += [of["duplicate_rows"].format(found.totals.duplicate_rows)] if found.totals.duplicate_rows else []
    said += [of["duplicate_ids"].format(*found.duplicate_id)] if found.duplicate_id else []
    said += [of[kind].format(c, n) for kind in ("emails", "dates", "numbers") for c, n in faults[kind].items()]
    said += [of["outliers"].format(c, n, *(round(found.columns[c][k], 4) for k in ("lower", "upper"))) for c, n in faults["outliers"].items()]
    said += [of["suspicious"].format(c, "; ".join(reasons)) for c, reasons in found.suspicious.items()]
    return said


def profile(df: DataFrame, place: str | None = None) -> Profile:
    """All of the above over one table. An empty table scores 0 and says so.

    First values are those in the order of the column ``place``, which is no part of the table, or else in that of a hash
    of the rows, so they are the same at any partitioning.

    Passes over the table: one for distinct values, one for fingerprints of rows (and one for those that come again), one
    for the first values of all text columns, one for all validity checks, three for all distributions, one for outliers,
    and one for the samples of all faults.
    """
    df = missing_as_null(df)
    order = [quoted(place)] if place else by_values(df)
    whole_df, df = df, df.drop(place) if place else df
    names = df.columns
    counted = distinct_counts(df, names).collect() if names else []
    counts = {r["column"]: r.asDict() for r in counted}
    whole = duplicate_rows(df).first() if names else {"n_rows": 0, "duplicates": 0}
    rows = whole["n_rows"]
    if not rows:
        return Profile(0, {}, Totals(0, len(names)), None, {k: {} for k in ("missing", "emails", "dates", "numbers", "outliers")}, {}, 0.0, ["Dataset is empty. Provide a file with data rows."])
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and not re.search(fixed.EMAIL_NAME, f.name, re.I)]
    mails = {r["column"] for r in email_shares(whole_df, texts, order).filter("share > 0.5").collect()} if texts else set()
    columns = {c: counts[c] | {"kind": kind(df, c, counts[c]["non_null"], counts[c]["distinct_values"], c in mails)} for c in names}
    checks: dict[tuple[str, str], Column] = {}
    for c in names:
        of, text = columns[c]["kind"], isinstance(df.schema[c].dataType, T.StringType)
        if text and of == "email":
            checks["emails", c] = invalid_email(quoted(c))
        if text and (of == "datetime (string)" or re.search(fixed.DATE_NAME, c, re.I)):
            checks["dates", c] = invalid_date(quoted(c))
        if text and of not in ("email", "phone", "categorical"):
            checks["numbers", c] = invalid_number(quoted(c))
    faults: dict[str, dict[str, int]] = {"missing": {c: counts[c]["nulls"] for c in names if counts[c]["nulls"]}, "emails": {}, "dates": {}, "numbers": {}, "outliers": {}}
    if checks:
        found = df.agg(*[F.count_if(bad).alias(str(i)) for i, bad in enumerate(checks.values())]).first()
        for i, (what, c) in enumerate(checks):
            if found[i]:
                faults[what][c] = found[i]
    numbers = [c for c in names if is_number(df, c)]
    if numbers:
        spread = distribution(df, numbers).collect()
        for r in [*spread, *outliers(df, numbers, bounds_of(spread)).collect()]:
            columns[r["column"]] |= r.asDict()
        faults["outliers"] = {c: columns[c]["outliers"] for c in numbers if columns[c].get("outliers")}
    bad = {f"{what} {c}": (check, quoted(c)) for (what, c), check in checks.items() if c in faults[what]}
    bad |= {f"outliers {c}": check for c, check in outlier_checks([(c, columns[c]["lower"], columns[c]["upper"]) for c in faults["outliers"]]).items()}
    samples: dict[str, dict[str, list[str]]] = {}
    for r in sorted(first_values(whole_df, bad, order, SAMPLES).collect(), key=lambda r: r["nth"]) if bad else []:
        what, c = r["kind"].split(" ", 1)
        samples.setdefault(what, {}).setdefault(c, []).append(r["value"])
    odd = {r["column"]: r["reasons"] for r in suspicious(df.sparkSession.createDataFrame(counted)).collect()}
    repeats = {c: counts[c]["non_null"] - counts[c]["distinct_values"] for c in names if is_id_name(c)}
    most = max(repeats, key=repeats.get, default=None)
    duplicate_id = (most, repeats[most]) if most is not None and repeats[most] else None
    totals = Totals(
        rows, len(names), sum(faults["missing"].values()), whole["duplicates"], duplicate_id[1] if duplicate_id else 0,
        *(sum(faults[k].values()) for k in ("emails", "dates", "numbers", "outliers")), len(odd),
    )
    made = Profile(rows, columns, totals, duplicate_id, faults, {c: odd[c] for c in names if c in odd}, score(totals))
    made.recommendations, made.samples = recommendations(made), samples
    return made


__all__ = ["Profile", "Totals", "clean", "distinct_counts", "distribution", "duplicate_ids", "duplicate_rows", "missing", "number", "outliers", "profile", "score", "suspicious"]
