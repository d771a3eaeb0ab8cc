"""Streams give what the batch operators give."""

from __future__ import annotations

from datetime import datetime, timedelta

from tessera.operators import incidents
from tessera.streaming import incidents as streams

SCHEMA = "ts timestamp, severity string, service string, message string, source_file string, line_no long"


def entries(spark, n=50):
    start = datetime(2024, 3, 1, 10)
    rows = [(start + timedelta(seconds=17 * i), ["ERROR", "INFO", "WARNING"][i % 3], "db", f"lost {i} of kind {'ab'[i % 2]}", "x.log", i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def ran(spark, tmp_path, frame, transform, name):
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = transform(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_timeline(spark, tmp_path):
    late = spark.createDataFrame([(datetime(2024, 3, 2), "INFO", "db", "end", "x.log", 99)], SCHEMA)
    own = entries(spark)
    rows = ran(spark, tmp_path, own.unionByName(late), streams.timeline, "timeline")
    expected = {tuple(r) for r in incidents.timeline(own).collect()}
    assert expected >= {tuple(r) for r in rows} and len(rows) in (0, len(expected))


def test_first_occurrences(spark, tmp_path):
    rows = ran(spark, tmp_path, entries(spark), streams.first_occurrences, "first")
    assert sorted(r["pattern"] for r in rows) == ["lost {n} of kind a", "lost {n} of kind b"]


def test_new_invoices(spark, tmp_path):
    frame = spark.createDataFrame([(datetime(2024, 1, d), n) for d, n in ((1, "A"), (2, "B"), (3, "A"))], "ts timestamp, invoice_number string")
    rows = ran(spark, tmp_path, frame, streams.new_invoices, "invoices")
    assert sorted(r["invoice_number"] for r in rows) == ["A", "B"]
