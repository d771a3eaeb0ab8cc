"""Round trips: driver tables are written to the shared folder in each form, read back by the readers, and compared."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tessera.operators import incidents, quality, records
from tessera.plans.catalog import query, table
from tessera.session import shared_folder
from tessera.sources import files, logs, tabular
from tessera.sources import records as documents
from tessera.sources.paths import joined


def place(spark, name):
    """A path in a new folder below the shared one."""
    return f"{shared_folder(spark)}/round-{uuid4().hex}/{name}"


NATIONS = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def src_csv_file(spark, sf_dir):
    """One CSV file that all tasks wrote, and its types as the reader finds them."""
    path = place(spark, "customers.csv")
    files.write_csv_file(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").repartition(5), path)
    return tabular.read_table(spark, path)


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, s_acctbal FROM supplier")
def src_csv_folder(spark, sf_dir):
    path = place(spark, "suppliers.csv")
    files.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return tabular.read_table(spark, path)


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderpriority AS priority, o_totalprice AS total FROM orders")
def src_json_file(spark, sf_dir):
    """One JSON array of nested records; parts of it come back as fields."""
    path = place(spark, "orders.json")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total")).alias("own"))
    files.write_json_file(orders.repartition(4), path)
    return records.flatten(documents.read_records(spark, path)).select("id", F.col("`own.priority`").alias("priority"), F.col("`own.total`").alias("total"))


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS BIGINT) AS n_regionkey FROM ({NATIONS})")
def src_ragged_json(spark, sf_dir):
    """A document for each region, under another key each, whose records do not all have the same fields."""
    row = F.when(F.col("n_nationkey") % 3 == 0, F.to_json(F.struct("n_nationkey", "n_name"))).otherwise(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")))
    each = nations(spark, sf_dir).groupBy("n_regionkey").agg(F.array_join(F.collect_list(row), ",").alias("rows"))
    path = place(spark, "regions")
    document = F.concat(F.lit('{"page": 1, "list'), F.col("n_regionkey"), F.lit('": ['), F.col("rows"), F.lit("]}"))
    each.repartition(5, "n_regionkey").select(document.alias("value"), F.col("n_regionkey").alias("region")).write.partitionBy("region").text(path)
    return documents.read_records(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_brand, p_size FROM part")
def src_orc(spark, sf_dir):
    path = place(spark, "parts.orc")
    table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").write.orc(path)
    return tabular.read_table(spark, path)


#: An event as a line of a log.
LINE = "CONCAT(DATE_FORMAT(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END, ' [svc', CAST(user_id % 5 AS STRING), '] event ', CAST(event_id AS STRING))"


def as_log(spark, sf_dir, name):
    """The events as one log file, in the order of their ids."""
    path = place(spark, name)
    rows = table(spark, sf_dir, "events").orderBy("event_id").select(F.expr(LINE).alias("value"))
    rows.write.text(f"{path}-parts")
    joined(spark, f"{path}-parts", path)
    return path


@query("SELECT event_id + 1 AS line_no, CAST(event_id AS VARCHAR) AS event FROM events")
def src_log_lines(spark, sf_dir):
    """Numbers of the lines of one log file that is read in many splits."""
    lines = logs.read_logs(spark, as_log(spark, sf_dir, "events.log"))
    return lines.select("line_no", F.regexp_extract("line", r"event (\d+)$", 1).alias("event"))


@query("""
SELECT 'svc' || user_id % 5 AS service, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS severity, count(*) AS n, min(event_id) + 1 AS first_line
FROM events GROUP BY 1, 2""")
def src_log_entries(spark, sf_dir):
    """The same file as entries."""
    entries = incidents.parse(logs.read_logs(spark, as_log(spark, sf_dir, "app.log")))
    return entries.groupBy("service", "severity").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


MINUTES = "SELECT date_trunc('minute', ts) AS t, count(*) AS total, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS warning, count(*) FILTER (event_type NOT IN ('error', 'click')) AS info FROM events GROUP BY 1"


@query(f"SELECT strftime(t, '%Y-%m-%dT%H:%M:00Z') AS timestamp_bucket, total AS total_count, error AS error_count, warning AS warning_count, info AS info_count FROM ({MINUTES})")
def snk_timeline(spark, sf_dir):
    """The stored timeline of the log file's entries."""
    path = place(spark, "timeline.csv")
    files.write_timeline(incidents.timeline(incidents.parse(logs.read_logs(spark, as_log(spark, sf_dir, "app.log")))), path)
    return spark.read.csv(path, header=True, schema="timestamp_bucket string, total_count long, error_count long, warning_count long, info_count long")


@query("""
SELECT count(*) AS total_lines_parsed, count(*) FILTER (event_type = 'error') AS total_errors, count(*) FILTER (event_type = 'click') AS total_warnings, count(*) FILTER (event_type NOT IN ('error', 'click')) AS total_info,
  CAST(0 AS BIGINT) AS parse_failures FROM events""")
def snk_incident_report(spark, sf_dir):
    """The summary of the stored report, read back as records."""
    path = place(spark, "incident_report.json")
    report = incidents.analyze(logs.read_logs(spark, as_log(spark, sf_dir, "app.log")))
    files.write_report(report, {}, path)
    report.release()
    return spark.read.json(path, multiLine=True).select("summary.*")


@query("""
SELECT 'orders' AS name, count(*) AS n_rows, CAST(round(min(o_totalprice) * 100) AS BIGINT) AS least, CAST(round(quantile_cont(o_totalprice, 0.5) * 100) AS BIGINT) AS median, CAST(round(max(o_totalprice) * 100) AS BIGINT) AS greatest FROM orders""")
def snk_quality_report(spark, sf_dir):
    """The stored quality report of a table, and what it says of one column, in cents."""
    path = place(spark, "orders_profile.json")
    files.write_profile(spark, quality.profile(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")), None, path)
    found = spark.read.json(path, multiLine=True)
    cents = lambda c: F.round(F.col(f"distributions.o_totalprice.{c}") * 100).cast("long")
    return found.select(F.lit("orders").alias("name"), F.col("rows").alias("n_rows"), cents("min").alias("least"), cents("median").alias("median"), cents("max").alias("greatest"))
