"""Operators with state give what the batch operators give, over restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import incidents, invoices
from tessera.session import drained
from tessera.streaming.anomalies import anomalies
from tessera.streaming.invoices import checked_invoices

INVOICE = "seq long, ts timestamp, invoice_number string, total double"
ENTRY = "ts timestamp, severity string, service string"


def arrived(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")


def some_invoices(n):
    rng = random.Random(6)
    numbers = [None, "", "HOT", *[f"N{i}" for i in range(12)]]
    return [(i, datetime(2024, 1, 1) + timedelta(hours=i), rng.choice(numbers + ["HOT"] * 5), float(i)) for i in range(n)]


def test_registry_over_restarts(spark, tmp_path):
    """The stream stops twice and goes on from its checkpoint; all marks are those of one batch."""
    rows, folder = some_invoices(90), str(tmp_path)
    known = spark.createDataFrame([("N3",), ("N4",), ("N4",), (None,)], "invoice_number string")
    for part in (rows[:20], rows[20:25], rows[25:]):
        random.Random(1).shuffle(part)
        stream = arrived(spark, part, INVOICE, folder, "in")
        found = drained(checked_invoices(stream, ["seq"], known), f"{folder}/out")
    expected = invoices.repeats(spark.createDataFrame(rows, INVOICE), ["seq"], known)
    marks = {(r["seq"], r["duplicate_check"]) for r in found.collect()}
    assert marks == {(r["seq"], r["duplicate_check"]) for r in expected.collect()} and found.count() == 90
    assert {m for _, m in marks} == {"passed", "warning", "skipped"}


def test_registry_forgets_by_event_time(spark, tmp_path):
    """A number passes again once the watermark is past its last invoice and ``keep``; known numbers stay."""
    start, folder = datetime(2024, 1, 1), str(tmp_path)
    batches = [[(1, 0, "A"), (2, 0, "K")], [(3, 2, "A")], [(4, 9, "B")], [(5, 10, "A"), (6, 10, "B"), (7, 10, "K")]]
    known = spark.createDataFrame([("K",)], "invoice_number string")
    for part in batches:
        rows = [(seq, start + timedelta(days=day), number, 1.0) for seq, day, number in part]
        stream = arrived(spark, rows, INVOICE, folder, "in")
        found = drained(checked_invoices(stream, ["seq"], known, keep=timedelta(days=5), late="1 hour"), f"{folder}/out")
    marks = {r["seq"]: r["duplicate_check"] for r in found.collect()}
    assert marks == {1: "passed", 2: "warning", 3: "warning", 4: "passed", 5: "passed", 6: "warning", 7: "warning"}


def entries_of(errors, start, service="db"):
    return [(start + timedelta(minutes=m, seconds=k % 60), "ERROR", service) for m, e in enumerate(errors) for k in range(e)] + [(start + timedelta(minutes=m), "INFO", service) for m in range(len(errors))]


def test_anomalies_over_restarts(spark, tmp_path):
    """After each part the last summary is the batch operator's over the minutes closed so far."""
    rng, folder, start = random.Random(2), str(tmp_path), datetime(2024, 5, 1)
    errors = [rng.choice([0, 1, 2, 3]) for _ in range(60)]
    errors[20], errors[41], errors[55] = 9, 30, 12
    all_rows = entries_of(errors, start)
    raised = []
    for until in (15, 30, 45, 60):
        part = [r for r in all_rows if start + timedelta(minutes=until - 15) <= r[0] < start + timedelta(minutes=until)]
        stream = arrived(spark, part, ENTRY, folder, "in")
        found = drained(anomalies(stream, late="0 seconds"), f"{folder}/out")
        last = found.orderBy(F.desc("upto")).first()
        so_far = spark.createDataFrame(all_rows, ENTRY).filter(F.col("ts") <= F.lit(start + timedelta(minutes=last["n"]) - timedelta(seconds=1)))
        batch = incidents.anomaly(incidents.timeline(so_far)).first()
        assert (last["start"], last["peak"]) == (batch["start"], batch["peak"])
        assert last["score"] == pytest.approx(batch["score"]) and last["baseline"] == pytest.approx(batch["baseline"])
        raised.append(sorted(r["start"] for r in found.filter("raised").collect()))
    assert last["n"] >= 59 and raised[-1][-1] == "2024-05-01T00:41:00Z" and "2024-05-01T00:20:00Z" in raised[-1]


def test_anomalies_by_service(spark, tmp_path):
    start = datetime(2024, 5, 1)
    rows = entries_of([1] * 10 + [20] + [1] * 5, start, "db") + entries_of([2] * 16, start, "web") + entries_of([0], start + timedelta(hours=2), "end")
    stream = arrived(spark, rows, ENTRY, str(tmp_path), "in")
    found = drained(anomalies(stream, late="0 seconds", by="service"), f"{tmp_path}/out")
    last = {r["key"]: r for r in found.orderBy("upto").collect()}
    assert last["db"]["start"] == "2024-05-01T00:10:00Z" and last["web"]["start"] is None and last["web"]["score"] == 0.0 and last["db"]["n"] == 16


def test_registry_by_groups(spark, tmp_path):
    """Numbers share the state of few groups, whose chunks are merged on the way; marks are those of one batch."""
    rows, folder = [(i, None, f"N{i * i % 97}", 0.0) for i in range(360)], str(tmp_path)
    for k in range(18):
        stream = arrived(spark, rows[k * 20 : k * 20 + 20][::-1], INVOICE, folder, "in")
    known = spark.createDataFrame([("N1",), ("N4",)], "invoice_number string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        found = drained(checked_invoices(stream, ["seq"], known, groups=2), f"{folder}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = invoices.repeats(spark.createDataFrame(rows, INVOICE), ["seq"], known)
    marks = {r["seq"]: r["duplicate_check"] for r in found.collect()}
    assert marks == {r["seq"]: r["duplicate_check"] for r in expected.collect()} and found.count() == 360
    assert spark.read.format("statestore").option("stateVarName", "seen").load(f"{folder}/out/state").select("key").distinct().count() == 2
