"""Streams over the driver tables, run to the end of what is there, and their batch SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tessera.plans.catalog import query, table
from tessera.session import drained, shared_folder
from tessera.streaming import incidents
from tessera.streaming.anomalies import anomalies
from tessera.streaming.invoices import checked_invoices


def arriving(spark, sf_dir, name):
    """A table as a stream of its files; one that is a single file is found in its folder by name."""
    batch = table(spark, sf_dir, name)
    reader = spark.readStream.schema(batch.schema)
    if batch.inputFiles()[0].endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARNING").when(F.col("event_type") == "view", "INFO").otherwise("UNKNOWN")
    return arriving(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), kind.alias("severity"))


def folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid4().hex}"


KINDS = "count(*) AS total, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS warning, count(*) FILTER (event_type = 'view') AS info"
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query(f"""
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:00Z') AS bucket, {KINDS} FROM events WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {CLOSED} GROUP BY 1""")
def stream_timeline(spark, sf_dir):
    """Minutes that the watermark has closed."""
    return drained(incidents.timeline(entries(spark, sf_dir)), folder(spark))


@query(f"""
WITH b AS (SELECT date_trunc('hour', ts) AS t, count(*) FILTER (event_type = 'error') AS error FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED} GROUP BY 1)
, s AS (SELECT count(*)::HUGEINT AS n, sum(error)::HUGEINT AS s, sum(error * error)::HUGEINT AS q, max(error) AS peak, avg(error) AS mean, stddev_pop(error) AS std FROM b)
SELECT any_value(n)::BIGINT AS n, strftime(min(t) FILTER (n * error > s AND (n * error - s) * (n * error - s) > 4 * (n * q - s * s)), '%Y-%m-%dT%H:00:00Z') AS start, any_value(peak) AS peak,
  CAST(floor((any_value(peak) - any_value(mean)) / any_value(std) * 100) AS BIGINT) AS score, CAST(floor(any_value(mean) * 100) AS BIGINT) AS baseline
FROM b, s""")
def stream_anomalies(spark, sf_dir):
    """The last summary of a stream of hours, in hundredths."""
    found = drained(anomalies(entries(spark, sf_dir), width="1 hour"), folder(spark))
    last = found.agg(F.max_by(F.struct("*"), "n").alias("x")).select("x.*")
    return last.select("n", "start", "peak", *[F.floor(F.col(c) * 100).cast("long").alias(c) for c in ("score", "baseline")])


NUMBER = "CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey - 1 WHEN o_orderkey % 10 = 0 THEN 1 WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey END"


@query(f"""
WITH i AS (SELECT o_orderkey, {NUMBER} AS number FROM orders)
SELECT o_orderkey, CASE WHEN number IS NULL THEN 'skipped' WHEN number % 17 = 3 OR row_number() OVER (PARTITION BY number ORDER BY o_orderkey) > 1 THEN 'warning' ELSE 'passed' END AS duplicate_check FROM i""")
def stream_invoice_registry(spark, sf_dir):
    """Orders as a stream of invoices; a tenth have one number, and every seventeenth number is known from before."""
    numbered = arriving(spark, sf_dir, "orders").select("o_orderkey", F.expr(NUMBER).cast("string").alias("invoice_number"))
    known = table(spark, sf_dir, "orders").select(F.expr(NUMBER).alias("number")).filter("number % 17 = 3").select(F.col("number").cast("string").alias("invoice_number"))
    return drained(checked_invoices(numbered, ["o_orderkey"], known), folder(spark)).select("o_orderkey", "duplicate_check")
