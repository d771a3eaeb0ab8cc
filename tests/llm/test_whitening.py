"""Whitening against exact fractions and a plain eigendecomposition."""

from __future__ import annotations

import math
import random
from fractions import Fraction
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening
from tessera.llm.whitening import State, Whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(vectors):
    return [(k, v) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def brute(vectors):
    """vec_id, deviation, whitened and explained by exact sums; rows by id and component."""
    rows = [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in usable(vectors)]
    n, d = len(rows), len(rows[0][1])
    sums = [sum(x[j] for _, x in rows) for j in range(d)]
    # n * n times the covariance, in whole numbers.
    centred = np.array([[n * x[j] - sums[j] for j in range(d)] for _, x in rows], object)
    exact = centred.T @ centred
    covariance = np.array([[float(Fraction(int(c), n**3)) for c in r] for r in exact])
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    made = {}
    for (k, _), y in zip(rows, centred, strict=True):
        own = (np.array([float(Fraction(int(c), n)) for c in y]) @ vectors_) / np.sqrt(values)
        made[k] = (sum(int(c) ** 2 for c in y), own)
    return n, made, values / np.trace(covariance)


def vectors_of(rng, n, d):
    mix = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    return [(i, [sum(m * rng.gauss(0, 1) * (j + 1) for j, m in enumerate(row)) / d for row in mix]) for i in range(n)]


@pytest.mark.parametrize("n,d,parts", [(300, 5, 7), (200, 40, 1), (64, 3, 64)])
def test_by_brute_force(spark, n, d, parts):
    vectors = vectors_of(random.Random(n), n, d)
    vectors += [(n + 1, None), (n + 2, [None] * d), (n + 3, [float("nan")] * d), (n + 4, [1.0] * (d - 1) + [float("-inf")]), (n + 5, [0.5] * (d - 1)), (n + 6, [])]
    df = spark.createDataFrame([(k, v, 0) for k, v in vectors], SCHEMA).repartition(parts)
    count, expected, explained = brute(vectors[:n])
    rows = whitening.whiten_embeddings(df).collect()
    assert len(rows) == n * min(d, 32) and count == n
    by = {(r["vec_id"], r["component"]): r for r in rows}
    signs = {c: np.sign(sum(by[k, c + 1]["whitened"] * own[c] for k, (_, own) in expected.items())) for c in range(min(d, 32))}
    for (k, c), r in by.items():
        assert r["deviation"] == expected[k][0] and r["n"] == n
        assert r["whitened"] * signs[c - 1] == pytest.approx(expected[k][1][c - 1], abs=1e-7)
        assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_partitioning_changes_nothing(spark):
    df = spark.createDataFrame([(k, v, 0) for k, v in vectors_of(random.Random(1), 400, 6)], SCHEMA)
    one, many = (whitening.fit(df.repartition(p)) for p in (1, 37))
    assert (one.sums == many.sums).all() and one.n == many.n
    assert np.allclose(one.components, many.components, atol=1e-10) and np.allclose(one.eigenvalues, many.eigenvalues, rtol=1e-12)


def test_merging_is_associative_and_keeps_digits():
    """Means of 10 ** 12 apart from a spread of one: plain sums of squares would keep nothing."""
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (900, 4)) + 10**12
    whole = State.of(x)
    in_turn = reduce(State.merged, [State.of(p) for p in np.array_split(x, 90)])
    backwards = State.of(x[:1])
    for k in range(1, 300):
        backwards = State.of(x[k : k + 1]).merged(backwards)
    exact = np.array([[float(v) for v in r] for r in (lambda y: y.T @ y)((x - 10**12).astype(object) * 900 - (x - 10**12).astype(object).sum(0))]) / 900**2
    for state in (whole, in_turn):
        assert (state.sums == x.astype(object).sum(0)).all() and np.allclose(state.scatter, exact, rtol=1e-12)
    assert np.allclose(backwards.scatter, State.of(x[:300]).scatter, rtol=1e-11)
    assert np.allclose(State.of_floats(x / 7).scatter * 49, exact, rtol=1e-3)


def test_large_counts_are_exact():
    model = Whitening(3 * 10**9, np.array([10**6 * 3 * 10**9 + 5, 7], object), np.array([1.0]), np.array([[1.0, 0.0]]), 1.0)
    x = np.array([[10**6 + 1, 2], [10**6, 0], [2**40, 0]])
    exact = [sum((3 * 10**9 * int(c) - int(s)) ** 2 for c, s in zip(r, model.sums, strict=True)) for r in x]
    assert model.deviations(x) == [e if e < 2**63 else None for e in exact] and model.deviations(x[1:2]) == [74]


def test_few_directions(spark):
    """Only directions in which something varies are components."""
    rng = random.Random(3)
    flat = [(i, [a := rng.gauss(0, 1), 2 * math.floor(a * 64) / 64, 0.25, b := rng.gauss(0, 1), b]) for i in range(100)]
    rows = whitening.whiten_embeddings(spark.createDataFrame([(k, v, 0) for k, v in flat], SCHEMA)).collect()
    components = {r["component"] for r in rows}
    assert components in ({1, 2}, {1, 2, 3}) and len(rows) == 100 * len(components) and rows[0]["identity_error"] < 1e-9


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(k, v, 0) for k, v in vectors_of(random.Random(5), 50, 3)], SCHEMA).withColumns({"whitened": F.lit("own"), "note": F.lit("kept"), "__x": F.lit(1)})
    made = whitening.whiten(df, whitening.fit(df))
    assert set(made.columns) == {"vec_id", "embedding", "label", "note", "__x", "whitened", "deviation"}
    x = np.array([r["whitened"] for r in made.collect()])
    assert np.allclose(x.T @ x / 50, np.eye(3), atol=1e-9) and made.first()["note"] == "kept"


def test_edges(spark):
    assert whitening.whiten_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([(1, None, 0)], [(1, [1.0, 2.0], 0)], [(i, [0.5, 0.5], 0) for i in range(9)], [(1, [], 0)]):
        found = whitening.whiten_embeddings(spark.createDataFrame(rows, SCHEMA))
        assert found.columns == names and found.count() == 0
    twice = whitening.whiten_embeddings(spark.createDataFrame([(None, [0.1], 0), (None, [0.1], 0), (3, [0.9], 0)], SCHEMA)).collect()
    assert len(twice) == 3 and {r["n"] for r in twice} == {3} and sum(r["whitened"] for r in twice) == pytest.approx(0)
    huge = whitening.whiten_embeddings(spark.createDataFrame([(1, [3e38], 0), (2, [1.0], 0), (3, [2.0], 0)], SCHEMA)).collect()
    assert {r["vec_id"] for r in huge} == {2, 3}
