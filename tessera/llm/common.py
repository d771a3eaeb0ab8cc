"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Used only by local sessions that name no spark.checkpoint.dir.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tessera"
#: Keys of at least one row in so many are looked up by a broadcast; there are no more than so many of them.
HOT_SHARE = 1000
#: What a task holds of a batch's text at once before it hands rows on.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local session without one gets a local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or LOCAL_CHECKPOINTS


#: The folder under which ``written`` puts its tables; ``scratch`` sets it.
FOLDERS: list[str] = []
#: What was broadcast by ``share`` within each ``scratch``.
SHARED: list[list[Broadcast]] = []


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store Spark finds it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables, checkpoints and what ``share`` broadcasts within are deleted at the end; results that need them must be stored before."""
    FOLDERS.append(f"{checkpoint_folder(spark)}/scratch-{uuid4().hex}")
    SHARED.append([])
    spark.sparkContext.setCheckpointDir(f"{FOLDERS[-1]}/checkpoints")
    try:
        yield
    finally:
        own = FOLDERS.pop()
        for value in SHARED.pop():
            value.destroy()
        spark.sparkContext.setCheckpointDir(f"{FOLDERS[-1]}/checkpoints" if FOLDERS else checkpoint_folder(spark))
        remove(spark, own)
        let_go_of_memory()


#: Spark's setting that deletes the shuffle files of an action at its end.
FREED_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions within go at the end of each, not when the driver happens to collect its garbage.

    For operators of many actions over stored tables; no DataFrame with a shuffle should be run twice within.
    """
    before = spark.conf.get(FREED_SHUFFLES, None)
    spark.conf.set(FREED_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED_SHUFFLES) if before is None else spark.conf.set(FREED_SHUFFLES, before)


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of bounded size, which the driver and all executors hold until ``scratch`` ends or nothing refers to it."""
    made = spark.sparkContext.broadcast(value)
    if SHARED:
        SHARED[-1].append(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a Parquet table: Spark knows its size, so that later joins broadcast it if it is small."""
    path = f"{FOLDERS[-1] if FOLDERS else checkpoint_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "left", counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``found``: its ``keys``, which are unique, ``n`` (rows that have them) and others.

    Keys that at least one row in HOT_SHARE has, HOT_SHARE of them at most, are looked up without a shuffle, so that no task
    gets all rows of a frequent key. ``counted`` has the keys and ``n`` of all rows; without it a frequent key that is not in
    ``found`` is not known as such.
    """
    found = written(found)
    sums = found if counted is None else counted
    frequent = F.col("n") * HOT_SHARE >= (sums.agg(F.sum("n")).first()[0] or 0)
    hot = found.filter(frequent).drop("n")
    if counted is not None:
        hot = counted.filter(frequent).select(*keys).join(hot, keys, how)
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    rare = marked.filter("__hot is null").select(*keys, *[F.col(f"`{c}`") for c in rows.columns if c not in keys])
    return marked.filter("__hot").drop("__hot").unionByName(rare.join(found.filter(~frequent).drop("n"), keys, how))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about SLICE_BYTES of ``column`` (one row at least)."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def values_of(column: pa.Array) -> list:
    """Python values; lists of numbers as numpy arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]


#: How to let go of what operators keep in a Python worker between tasks, by the modules whose functions use it.
HELD: dict[tuple[str, ...], Callable[[], None]] = {}


def let_go_for(module: str) -> None:
    """Workers go on to the stages of other operators; what only those before need would add up there."""
    for users, clear in HELD.items():
        if module not in users:
            clear()
    let_go_of_memory()


def let_go_of_memory() -> None:
    """What the allocators of this process keep of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def map_rows(df: DataFrame, column: str, added: T.StructType, compute: Callable[[], Callable]) -> DataFrame:
    """``df`` with the columns of ``added``: for each row, what the function that ``compute()`` returns makes of ``column``.

    ``compute`` runs once in each Python task, to load what the task needs. The function takes the value (None where it is
    null) and returns a tuple in the order of ``added``; if it has a method ``many``, that gets the values of a slice and
    returns their tuples. A column of ``df`` with the name of an added one is replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in added.fieldNames()]
    schema = T.StructType([*kept, *added.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]
    source = column if column in names else f"__{column}"
    read = df if source == column else df.withColumnRenamed(column, source)
    fields = [arrow.field(i) for i in range(len(names), len(arrow))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go_for(compute.__module__)
        function = compute()
        for batch in slices(batches, source):
            values = values_of(batch.column(source))
            rows = function.many(values) if hasattr(function, "many") else [function(x) for x in values]
            made = [pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).cast(arrow.field(n).type) for n in names), *made], schema=arrow)

    return read.select(*[f"`{n}`" for n in dict.fromkeys([*names, source])]).mapInArrow(run, schema)
