"""Whitening of embeddings: exact sums and centred scatters of partitions, merged by Chan's formula in treeReduce.

Entries become integers (``steps``: floor(SCALE * c) + SHIFT), so sums are exact. A partition's state is its count, the
sums of its vectors and the scatter around its own mean; two states merge pairwise, with the difference of means taken from
the exact sums, so that neither large counts nor a large common offset cost digits. The scatter's unit eigenvectors
(``eigh``, on the driver) are the components. A second pass whitens all vectors and merges the covariance of what it gets
the same way, which must be the identity.

States are d * d numbers; merging in a tree of MERGED children keeps at most so many of them in a task or on the driver.

Null vectors, and those with null or non-finite entries, are left out, as are entries too large for a long after scaling.
Vectors of another length than the commonest (the longest of equals) can't be compared with the others and are left out too.
Directions in which nothing varies (eigenvalues within rounding of zero) are no components: rows that are all equal, or a
single row, give none, and so an empty result, as does an empty table. Repeated rows count each. Rows with a null key stay.
Extra columns pass through ``whiten``; one with the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_rows

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Scaled entries lie below this in size; sums and differences of so many rows of them stay exact.
LARGEST = float(1 << 52)
#: Numbers of a batch that are multiplied at once.
AT_ONCE = 1 << 20
#: States that are merged at once.
MERGED = 8
EIGEN_NOISE = 16 * np.finfo(float).eps


@dataclass
class State:
    """Count, exact sums (Python integers, or floats for whitened values) and scatter around the mean."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> State:
        """Of integers: shifted by a whole number near the mean before anything is squared."""
        sums = x.astype(object).sum(0) if abs(x).max(initial=0) * len(x) >= 1 << 62 else x.sum(0).astype(object)
        near = np.array([s // len(x) for s in sums], np.int64)
        y = (x - near).astype(float)
        y -= (sums - near.astype(object) * len(x)).astype(float) / len(x)
        return State(len(x), sums, y.T @ y)

    @staticmethod
    def of_floats(x: np.ndarray) -> State:
        mean = x.mean(0)
        y = x - mean
        mean, y = mean + y.mean(0), y - y.mean(0)  # what rounding left in the mean
        return State(len(x), mean * len(x), y.T @ y)

    def merged(self, other: State) -> State:
        n = self.n + other.n
        if self.sums.dtype == object:
            apart = (other.sums * self.n - self.sums * other.n).astype(float) / self.n / other.n
        else:
            apart = other.sums / other.n - self.sums / self.n
        return State(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (self.n / n * other.n))


@dataclass
class Whitening:
    """``components``: a row for each, largest eigenvalue first. ``identity_error`` is None until the second pass."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None
    #: Components over the roots of their eigenvalues, as columns.
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        self.weights = self.components.T / np.sqrt(self.eigenvalues)
        self.near = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = (self.sums - self.near.astype(object) * self.n).astype(float) / self.n

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.near).astype(float) - self.rest) @ self.weights

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sums) ** 2, exact; null where a long can't hold them."""
        far = max(int(abs(x - self.near).max(initial=0)) + 1, 1)
        if self.dimensions * (self.n * far) ** 2 < 1 << 63:
            y = (x - self.near) * self.n - (self.sums - self.near.astype(object) * self.n).astype(np.int64)
            return (y * y).sum(1).tolist()
        y = x.astype(object) * self.n - self.sums
        return [d if d < 1 << 63 else None for d in (y * y).sum(1)]

    @staticmethod
    def of(state: State, components: int = COMPONENTS) -> Whitening:
        covariance = state.scatter / state.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = min(components, int((values > EIGEN_NOISE * len(values) * max(values[0], 0)).sum()))
        signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
        return Whitening(state.n, state.sums, values[:kept], (vectors * signs).T[:kept], float(np.trace(covariance)))


# Vectors as integers.


def steps(vector: Column) -> Column:
    """floor(SCALE * c) + SHIFT of each entry, by Spark; null for vectors that are left out."""
    x = vector.cast("array<double>")
    fits = F.forall(x, lambda c: F.coalesce(F.abs(c * SCALE) < LARGEST, F.lit(False)))
    return F.when(fits, F.transform(x, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def usual_length(df: DataFrame, column: str) -> int | None:
    """The commonest length of vectors; one row comes to the driver."""
    counted = df.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d"))
    first = counted.first()
    return first["d"] if first else None


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def merged_states(df: DataFrame, column: str, of, dimensions: int) -> State:
    """The state of all rows' vectors: partitions make theirs, treeReduce merges them."""
    rows = max(1, AT_ONCE // max(1, dimensions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                own = of(matrix(batch.column(column).slice(at, rows)))
                state = own if state is None else state.merged(own)
        if state is not None:
            sums = [str(s) for s in state.sums] if state.sums.dtype == object else [float(s).hex() for s in state.sums]
            yield pa.RecordBatch.from_pydict({"n": [state.n], "sums": [sums], "scatter": [state.scatter.tobytes()]})

    def back(r) -> State:
        exact = not r["sums"] or "x" not in r["sums"][0]
        sums = np.array([int(s) if exact else float.fromhex(s) for s in r["sums"]], object if exact else float)
        return State(r["n"], sums, np.frombuffer(r["scatter"]).reshape(len(sums), -1))

    states = df.select(column).mapInArrow(run, "n long, sums array<string>, scatter binary").rdd
    depth = max(2, ceil(log(max(states.getNumPartitions(), 2), MERGED)))
    return states.map(back).treeReduce(State.merged, depth)


def prepared(df: DataFrame, vector: str) -> tuple[DataFrame, int | None]:
    """``df`` with ``__x``, the integers of the vectors that take part, and their length; other rows are left out."""
    taken = df.withColumn("__x", steps(F.col(f"`{vector}`"))).filter("__x is not null")
    length = usual_length(taken.select("__x"), "__x")
    return taken.filter(F.size("__x") == F.lit(length or 0)), length


def projected(df: DataFrame, model: Whitening, x: str = "__x") -> DataFrame:
    """``df`` with ``whitened`` and ``deviation`` instead of ``x``, the vectors as integers."""

    class Rows:
        def many(self, values: list[np.ndarray]) -> list[tuple]:
            own = np.stack(values)
            return list(zip(model.project(own), model.deviations(own), strict=True))

    made = T.StructType([T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
    return map_rows(df, x, made, Rows).drop(x)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the table's vectors, with its identity error by a second pass; None where nothing varies."""
    taken, length = prepared(df.select(F.col(f"`{vector}`").alias("v")), "v")
    if not length:
        return None
    model = Whitening.of(merged_states(taken, "__x", State.of, length), components)
    if not len(model.eigenvalues):
        return None
    whitened = projected(taken.select("__x"), model).select("whitened")
    state = merged_states(whitened, "whitened", State.of_floats, len(model.eigenvalues))
    error = np.abs(state.scatter / state.n - np.eye(len(state.scatter))).max()
    return replace(model, identity_error=float(error))


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Rows of ``df`` whose vectors take part, with ``whitened`` (array<double>) and ``deviation``."""
    x = "__x"
    while x in df.columns:
        x += "_"
    taken = df.withColumn(x, steps(F.col(f"`{vector}`"))).filter(F.size(x) == F.lit(model.dimensions))
    return projected(taken, model, x)


def whiten_embeddings(df: DataFrame) -> DataFrame:
    """The columns of op13: a row for each vector and component."""
    model = fit(df.select("embedding"))
    if model is None:
        return df.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]).limit(0)
    rows = whiten(df.select("vec_id", "embedding"), model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
