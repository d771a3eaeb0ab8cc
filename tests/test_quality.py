"""Profiles of small tables, against pandas where it has the statistic."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tessera.operators import quality, quantiles, samples


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        amount = None if i % 30 == 7 else float(rng.randint(10, 20)) if i != 50 else 900.0
        mail = f"u{i}@example.com" if i % 12 else "broken@"
        rows.append((i // 2, mail, "2024-01-05" if i % 10 else "soon", amount, rng.choice(["a", "b", None]), f"note {i}", 1, None if i > 10 else "x", i % 2 == 0))
    rows += rows[:3]
    return spark.createDataFrame(rows, "customer_id long, email string, signup_date string, amount double, segment string, notes string, constant int, rare string, active boolean")


def test_statistics_as_pandas(table):
    own = table.toPandas()
    missing = {r["column"]: r["missing"] for r in quality.missing(table).collect()}
    assert missing == own.isna().sum().to_dict()
    assert quality.duplicate_rows(table).first()["duplicates"] == own.duplicated().sum()
    found = {r["column"]: r for r in quality.distribution(table, ["amount", "customer_id"]).collect()}
    for c in ("amount", "customer_id"):
        x = own[c].astype(float)
        expected = (x.mean(), x.median(), x.std(), x.min(), x.max(), x.quantile(0.25), x.quantile(0.75))
        assert tuple(found[c][k] for k in ("mean", "median", "std", "least", "greatest", "q1", "q3")) == pytest.approx(expected)
    counts = {r["column"]: (r["non_null"], r["distinct_values"]) for r in quality.distinct_counts(table, table.columns).collect()}
    assert counts == {c: (own[c].count(), own[c].nunique()) for c in own}


def test_outliers(table):
    own = table.toPandas()["amount"].dropna()
    q1, q3 = own.quantile(0.25), own.quantile(0.75)
    far = own[(own < q1 - 1.5 * (q3 - q1)) | (own > q3 + 1.5 * (q3 - q1))]
    assert quality.outliers(table, ["amount"]).first()["outliers"] == len(far) > 0
    assert {r["value"] for r in quality.outlier_samples(table, ["amount"], ["notes"]).collect()} == set(far)


def test_profile(table):
    found = quality.profile(table)
    kinds = {c: x["kind"] for c, x in found.columns.items()}
    assert kinds == {"customer_id": "integer", "email": "email", "signup_date": "datetime (string)", "amount": "float", "segment": "categorical", "notes": "text", "constant": "integer", "rare": "text", "active": "boolean"}
    assert found.faults["emails"] == {"email": 11} and found.faults["dates"] == {"signup_date": 13}
    assert found.duplicate_id == ("customer_id", 63) and found.totals.duplicate_rows == 3
    assert found.suspicious == {"constant": ["constant"], "notes": ["very high cardinality"], "rare": ["mostly missing", "constant"]}
    assert 0 < found.score < 100 and len(found.recommendations) >= 8


def test_scores():
    assert quality.score(quality.Totals(0, 3)) == 0.0
    assert quality.score(quality.Totals(100, 2)) == 100.0
    assert quality.score(quality.Totals(100, 2, missing=20, duplicate_rows=5, suspicious=1)) == 100 - 10 - 5 - 10
    assert quality.score(quality.Totals(10, 1, 10, 10, 10, 10, 10, 10, 10, 1)) == 0.0


def test_cleaning(spark, table):
    own = table.toPandas()
    cleaned = quality.clean(table).toPandas()
    assert len(cleaned) == len(own.drop_duplicates())
    assert cleaned["amount"].isna().sum() == 0 and (own.drop_duplicates()["amount"].median() == cleaned["amount"]).sum() > 0
    assert set(cleaned["segment"]) == {"a", "b"} and set(cleaned["rare"]) == {"x"}
    ties = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    assert sorted(r[0] for r in quality.clean(ties).collect()) == ["a", "a", "b"]


def test_edges(spark):
    empty = quality.profile(spark.createDataFrame([], "id long, name string"))
    assert empty.score == 0.0 and len(empty.recommendations) == 1
    nan = spark.createDataFrame(pd.DataFrame({"x": [1.0, float("nan"), 2.0], "odd`name": ["a", None, "a"]}))
    assert {r["column"]: r["missing"] for r in quality.missing(nan).collect()} == {"x": 1, "odd`name": 1}
    few = spark.createDataFrame([(1,), (2,), (900,)], "n int")
    assert quality.outliers(few, ["n"]).count() == 0 and quality.outlier_samples(few, ["n"], ["n"]).count() == 0
    assert quality.profile(few.select("n", (few["n"] > 1).alias("flag"))).columns["flag"]["kind"] == "boolean"


def exact(df, columns, fractions):
    found = quantiles.quantiles(df, {c: F.col(c).cast("double") for c in columns}, fractions)
    return {c: x["quantiles"] for c, x in found.items()}


FRACTIONS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("inner", [20_000, 3])
def test_quantiles_as_numpy(spark, monkeypatch, inner):
    """With brackets that are sorted at once, and with so little allowed that they are narrowed again and again."""
    monkeypatch.setattr(quantiles, "INNER", inner)
    rng = np.random.default_rng(4)
    own = pd.DataFrame({
        "even": rng.random(5000), "ties": rng.integers(0, 4, 5000).astype(float), "heavy": np.where(rng.random(5000) < 0.4, 7.5, rng.standard_cauchy(5000)),
        "wide": rng.choice([1e-300, -1e300, 1e300, 0.0, 5e-324], 5000) * rng.random(5000), "same": np.full(5000, 3.25), "two": np.r_[np.zeros(2500), np.ones(2500)],
    })
    found = exact(spark.createDataFrame(own).repartition(6), list(own), FRACTIONS)
    for c in own:
        assert found[c] == pytest.approx([own[c].quantile(p) for p in FRACTIONS], rel=1e-12), c


def test_quantiles_when_the_sketch_is_wrong(spark, monkeypatch):
    """Brackets that miss their ranks on either side are refuted by the counts."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    for p, shown in ((0.5, 0.9), (0.5, 0.1), (0.0, 1.0), (1.0, 0.0)):
        monkeypatch.setattr(quantiles, "brackets", lambda fractions, shown=shown: [shown, shown])
        assert exact(df, ["x"], [p]) == {"x": [999 * p]}


def test_quantiles_of_ten_million_distinct_values(spark):
    """Exact, while no more than INNER values of a bracket are ever sorted, and no buffer holds all distinct ones."""
    n = 10_000_000
    df = spark.range(0, n, 1, 16).select(((F.col("id") * 7_368_787) % n / 3.0).alias("x"))
    sorted_values, inner_values = [], quantiles.inner_values

    def watched(*args):
        made = inner_values(*args)
        sorted_values.append(made.groupBy("rank").count().agg(F.max("count")).first()[0])
        return made

    quantiles.inner_values = watched
    try:
        found = exact(df, ["x"], [0.25, 0.5, 0.75])["x"]
    finally:
        quantiles.inner_values = inner_values
    assert found == pytest.approx([p * (n - 1) / 3.0 for p in (0.25, 0.5, 0.75)], rel=1e-15)
    assert sorted_values and max(sorted_values) <= quantiles.INNER


def test_quantiles_at_the_edges(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), (None, 2.0)], "none double, few double")
    found = quantiles.quantiles(df, {c: F.col(c) for c in df.columns}, [0.5])
    assert found["none"]["n"] == 0 and found["none"]["quantiles"] == [None] and found["few"]["quantiles"] == [1.5]
    assert quantiles.quantiles(df, {}, [0.5]) == {} and exact(df.limit(0), ["few"], [0.5]) == {"few": [None]}


def test_first_values_at_any_partitioning(spark):
    df = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("at"), (F.col("id") % 5).alias("v"))
    kinds = {"odd": (F.col("v") % 2 == 1, F.col("v")), "none": (F.col("v") > 9, F.col("v")), "all": (F.lit(True), F.when(F.col("at") > 2, F.col("at")))}
    made = [sorted(tuple(r) for r in samples.first_values(d, kinds, [F.col("at")], 4).collect()) for d in (df, df.repartition(90), df.coalesce(1))]
    assert made[0] == made[1] == made[2]
    at = {(r["at"], r["v"]) for r in df.collect()}
    odd = [str(v) for _, v in sorted((a, v) for a, v in at if v % 2)[:4]]
    assert [v for k, _, v in made[0] if k == "odd"] == odd and [v for k, _, v in made[0] if k == "all"] == [None, None, None, "3"]
    assert not [k for k, _, _ in made[0] if k == "none"] and samples.first_values(df, {}, [F.col("at")], 4).count() == 0


def test_first_values_in_one_job(spark):
    """One window per step for all kinds, each below a limit of the groups, so that tasks hand on k rows for each kind."""
    df = spark.range(100).withColumnRenamed("id", "x")
    plan = samples.first_values(df, {str(i): (F.col("x") > i, F.col("x")) for i in range(20)}, [F.col("x")], 3)._jdf.queryExecution().toString()
    assert plan.split("Physical Plan")[1].count("WindowGroupLimit") == 4 and plan.split("Physical Plan")[1].count("Range (") == 1


def test_fingerprints_tell_places_of_nulls(spark):
    rows = [(None, "a"), ("a", None), (None, "a"), (None, None), (None, None), ("a", "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert sorted(map(str, quality.distinct_rows(df).collect())) == sorted(map(str, df.dropDuplicates().collect()))
    assert tuple(quality.duplicate_rows(df).first()) == (6, 2) and tuple(quality.duplicate_rows(df.limit(0)).first()) == (0, 0)
    nan = spark.createDataFrame([(float("nan"), 0.0), (float("nan"), -0.0), (None, 0.0)], "x double, y double")
    assert quality.duplicate_rows(nan).first()["duplicates"] == 2


def test_equal_fingerprints_of_unequal_rows(spark, monkeypatch):
    """Whole rows decide where fingerprints collide."""
    monkeypatch.setattr(quality, "fingerprint", lambda df: [F.lit(1), F.lit(2)])
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, None)], "x int, y string")
    assert quality.distinct_rows(df).count() == 3 and tuple(quality.duplicate_rows(df).first()) == (4, 1)


def test_report_document(spark, table):
    found = quality.profile(table.repartition(3))
    made = found.document("x_cleaned.csv")
    assert made["rows"] == 123 and made["cleaned_file"] == "x_cleaned.csv" and made["quality_score"] == found.score
    assert made["issues"]["invalid_emails"]["email"]["count"] == 11 and set(made["issues"]["invalid_emails"]["email"]["samples"]) == {"broken@"}
    assert made["issues"]["outliers"]["amount"]["samples"] == ["900.0"] and made["issues"]["outliers"]["amount"]["lower_bound"] is not None
    assert made["issues"]["duplicate_ids"] == {"column": "customer_id", "count": 63} and made["distributions"]["amount"]["max"] == 900.0
    frame = {(r["kind"], r["column"]): r["count"] for r in quality.issue_frame(spark, found).collect()}
    assert frame["emails", "email"] == 11 and frame["outliers", "amount"] == 1


def test_clean_without_repeats_joins_nothing(spark):
    """Passes over a table without repeats are scans; with repeats the distinct rows are stored once. Values are the same either way."""
    rows = [(i, None if i % 4 == 0 else float(i), i * 1.5, None if i % 5 == 0 else "ab"[i % 2], "z") for i in range(40)]
    schema = "id long, `a gap` double, full double, text string, same string"
    once, twice = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + rows[:15], schema)
    found = [quality.clean(df) for df in (once, twice)]
    assert found[0].schema.simpleString() == found[1].schema.simpleString() == "struct<id:double,a gap:double,full:double,text:string,same:string>"
    assert sorted(found[0].collect()) == sorted(found[1].collect())
    median, common = np.median([r[1] for r in rows if r[1] is not None]), "a" if sum(r[3] == "a" for r in rows) >= sum(r[3] == "b" for r in rows) else "b"
    assert sorted(tuple(r) for r in found[0].collect()) == sorted((float(r[0]), median if r[1] is None else r[1], r[2], common if r[3] is None else r[3], "z") for r in rows)
    assert all(word not in df._jdf.queryExecution().optimizedPlan().toString() for df in found for word in ("Join", "Aggregate"))
