"""Sessions with the settings the engine counts on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What state by key and timers need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def session(master: str | None = None, app: str = "tessera", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` use ``_`` where Spark's keys have dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config(map=STATE_STORE)
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; local sessions without one get their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="tessera-")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input that is there now, as a table below ``folder``; a later call goes on from there.

    The session gets a state store that has what state by key needs.
    """
    spark = stream.sparkSession
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
