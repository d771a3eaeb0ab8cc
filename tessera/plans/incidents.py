"""Queries on logs; the events stand for log entries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import minute, pattern_of
from tessera.functions.fixed import ADVICE
from tessera.operators import incidents
from tessera.plans.catalog import ORACLE, QUERIES, Given, query

ENTRIES = Given("""
SELECT ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity,
  CONCAT('svc', CAST(user_id % 7 AS STRING)) AS service,
  CONCAT('job', CAST(user_id % 23 AS STRING), ' on 10.0.', CAST(event_id % 200 AS STRING), '.7:8080 at /var/run', CAST(event_id % 5 AS STRING), '/x failed after ', CAST(event_id AS STRING),
    ' ms for u', CAST(user_id AS STRING), '@example.com id 0xbeef', CAST(event_id % 10 AS STRING), ' since 2024-01-02 03:04:05') AS message,
  'events.log' AS source_file, event_id AS line_no FROM {events}""")
#: What the messages of ENTRIES become.
PATTERN = "concat('job', user_id % 23, ' on {ip}:{port} at {path} failed after {n} ms for {email} id {hex} since {timestamp}')"


def entries(spark, sf_dir):
    found = ENTRIES(spark, sf_dir)
    return found.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("raw", F.col("message"))


@query(f"""
SELECT count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos, count(*) AS total, false AS has_fatal
FROM ({ENTRIES.sql})""")
def log_severity_counts(spark, sf_dir):
    return incidents.severity_counts(entries(spark, sf_dir)).select("errors", "warnings", "infos", "total", "has_fatal")


COUNTS = "count(*) AS total, count(*) FILTER (severity = 'ERROR') AS error, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info"


@query(f"SELECT strftime(ts, '%Y-%m-%dT%H:%M:00Z') AS bucket, {COUNTS} FROM ({ENTRIES.sql}) GROUP BY 1")
def log_timeline_minute(spark, sf_dir):
    return incidents.timeline(entries(spark, sf_dir))


HOURS = f"SELECT strftime(ts, '%Y-%m-%dT%H:00:00Z') AS bucket, {COUNTS} FROM ({ENTRIES.sql}) GROUP BY 1"


def hours(spark, sf_dir):
    hour = F.date_format(F.date_trunc("hour", F.col("ts")), "yyyy-MM-dd'T'HH:00:00'Z'")
    return incidents.timeline(entries(spark, sf_dir), hour)


@query(f"""
WITH b AS ({HOURS}), s AS (SELECT count(*)::HUGEINT AS n, sum(error)::HUGEINT AS s, sum(error * error)::HUGEINT AS q FROM b)
SELECT bucket, total, error, warning, info, n * error > s AND (n * error - s) * (n * error - s) > 4 * (n * q - s * s) AS anomalous FROM b, s""")
def log_anomaly_zscore(spark, sf_dir):
    return incidents.flags(hours(spark, sf_dir))


@query(f"""
WITH b AS ({HOURS}), s AS (SELECT count(*)::HUGEINT AS n, sum(error)::HUGEINT AS s, sum(error * error)::HUGEINT AS q FROM b)
SELECT min(bucket) FILTER (n * error > s AND (n * error - s) * (n * error - s) > 4 * (n * q - s * s)) AS start, max(error) AS peak FROM b, s""")
def log_anomaly_summary(spark, sf_dir):
    return incidents.anomaly(hours(spark, sf_dir)).select("start", "peak")


@query(f"""
WITH b AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:00Z') AS bucket, {COUNTS} FROM ({ENTRIES.sql}) GROUP BY 1)
, p AS (SELECT max(error) AS peak, count(*) FILTER (error > 0) AS error_minutes FROM b)
SELECT peak, error_minutes, false AS has_fatal, CASE WHEN peak > 1000 THEN 'CRITICAL' WHEN peak > 100 OR error_minutes > 10 THEN 'HIGH' WHEN peak > 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM p""")
def log_incident_severity(spark, sf_dir):
    return incidents.classify(entries(spark, sf_dir))


@query("""
WITH e AS (SELECT date_trunc('minute', ts) AS t, event_type FROM events), a AS (SELECT min(t) AS a, max(t) AS b FROM e)
, every AS (SELECT unnest(generate_series(a, b, INTERVAL 1 MINUTE)) AS t FROM a)
SELECT strftime(every.t, '%Y-%m-%dT%H:%M:00Z') AS bucket, count(event_type) AS total, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS warning,
  count(*) FILTER (event_type NOT IN ('error', 'purchase')) AS info
FROM every LEFT JOIN e USING (t) GROUP BY every.t""")
def log_timeline_filled(spark, sf_dir):
    return incidents.fill_gaps(incidents.timeline(entries(spark, sf_dir)))


RANGE = "2024-01-10T00:00:00Z/2024-01-20T12:30:00Z"


@query(f"SELECT severity, count(*) AS n FROM ({ENTRIES.sql}) WHERE ts BETWEEN '2024-01-10 00:00:00' AND '2024-01-20 12:30:00' GROUP BY severity")
def log_time_range_filter(spark, sf_dir):
    return incidents.within(entries(spark, sf_dir), *incidents.time_range(RANGE)).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"SELECT severity, count(*) AS n FROM ({ENTRIES.sql}) WHERE severity IN ('WARNING', 'ERROR') GROUP BY severity")
def log_severity_threshold(spark, sf_dir):
    return incidents.at_least(entries(spark, sf_dir), "warn").groupBy("severity").agg(F.count("*").alias("n"))


@query(f"SELECT {PATTERN} AS pattern, count(*) AS n FROM events GROUP BY 1")
def log_pattern_normalize(spark, sf_dir):
    return entries(spark, sf_dir).groupBy(pattern_of(F.col("message")).alias("pattern")).agg(F.count("*").alias("n"))


ERROR_PATTERNS = f"""
SELECT {PATTERN} AS pattern, count(*) AS n, strftime(min(ts), '%Y-%m-%dT%H:%M:00Z') AS first_minute, strftime(max(ts), '%Y-%m-%dT%H:%M:00Z') AS last_minute,
  array_to_string(list_sort(list(DISTINCT concat('svc', user_id % 7))), ';') AS services, min(event_id) AS first_line
FROM events WHERE event_type = 'error' GROUP BY 1"""


@query(f"SELECT * FROM ({ERROR_PATTERNS}) ORDER BY n DESC, first_line LIMIT 20")
def log_top_error_patterns(spark, sf_dir):
    found = incidents.top_patterns(incidents.error_patterns(entries(spark, sf_dir)))
    return found.select("pattern", "n", minute(F.col("first_seen")).alias("first_minute"), minute(F.col("last_seen")).alias("last_minute"), F.array_join("services", ";").alias("services"), F.col("first_place.line_no").alias("first_line"))


@query("SELECT concat('svc', user_id % 7) AS service, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1")
def log_services_affected(spark, sf_dir):
    return incidents.affected_services(entries(spark, sf_dir))


@query(f"""
WITH p AS (SELECT pattern, n, row_number() OVER (ORDER BY n DESC, first_line) AS r FROM ({ERROR_PATTERNS}))
SELECT pattern, CASE WHEN n > 1000 THEN 'High-frequency error pattern (' || n || ' occurrences): "' || left(pattern, 80) || '" — investigate root cause urgently' END AS advice FROM p WHERE r <= 5""")
def log_recommendations(spark, sf_dir):
    top = incidents.top_patterns(incidents.error_patterns(entries(spark, sf_dir)), 5)
    return top.select("pattern", incidents.advice(F.col("pattern"), F.col("n"), F.col("services")).alias("advice"))


SPLIT = "2024-01-15 00:00:00"


@query(f"""
WITH e AS (SELECT {PATTERN} AS pattern, ts FROM events WHERE event_type = 'error')
SELECT pattern, count(*) FILTER (ts < '{SPLIT}') AS count_in_a, count(*) FILTER (ts >= '{SPLIT}') AS count_in_b,
  CASE WHEN count(*) FILTER (ts < '{SPLIT}') = 0 THEN 'b' WHEN count(*) FILTER (ts >= '{SPLIT}') = 0 THEN 'a' ELSE 'both' END AS side
FROM e GROUP BY pattern""")
def log_compare_patterns(spark, sf_dir):
    every = entries(spark, sf_dir)
    halves = [incidents.error_patterns(every.filter(c)) for c in (F.col("ts") < SPLIT, F.col("ts") >= SPLIT)]
    return incidents.compare_patterns(*halves)


@query(f"""
WITH e AS (SELECT DISTINCT {PATTERN} AS pattern, ts < '{SPLIT}' AS a FROM events WHERE event_type = 'error')
, s AS (SELECT pattern, bool_or(a) AS a, bool_or(NOT a) AS b FROM e GROUP BY pattern)
, j AS (SELECT count(*) FILTER (a AND b) AS common, count(*) AS every FROM s)
SELECT common, every, CASE WHEN every = 0 THEN 0 ELSE common * 100 // every END AS percent, CASE WHEN common * 100 >= 80 * every THEN 'HIGH' WHEN common * 100 >= 50 * every THEN 'MODERATE'
  WHEN common * 100 >= 20 * every THEN 'LOW' ELSE 'MINIMAL' END AS band FROM j""")
def log_compare_jaccard(spark, sf_dir):
    every = entries(spark, sf_dir).filter(incidents.is_error()).withColumn("pattern", pattern_of(F.col("message")))
    sides = every.filter("ts is not null and pattern is not null").groupBy("pattern").agg(F.bool_or(F.col("ts") < SPLIT).alias("a"), F.bool_or(F.col("ts") >= SPLIT).alias("b"))
    both = sides.agg(F.count_if(F.col("a") & F.col("b")).alias("common"), F.count("*").alias("every"))
    share = F.when(F.col("every") == 0, F.lit(0.0)).otherwise(F.col("common") * 100 / F.greatest("every", F.lit(1)))
    return both.select("common", "every", F.floor(share).cast("long").alias("percent"), incidents.band(share).alias("band"))


# Lines of each format, rendered from the events, and what must come back.

FORMATS = ("standard", "bracket_iso", "iso_flex", "access", "syslog", "json", "fallback")


def line_of(name: str) -> Column:
    """The line of an entry in a format."""
    second = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    short = F.concat_ws(" ", F.lit("job"), F.col("line_no"), F.lit("done"))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    level, service = F.col("severity"), F.col("service")
    status = F.expr("case severity when 'ERROR' then '503' when 'WARNING' then '404' else '200' end")
    prefix = F.expr("case severity when 'ERROR' then 'err: ' when 'WARNING' then 'WARN ' else '' end")
    return {
        "standard": say(second, " ", level, " [", service, "] ", short),
        "bracket_iso": say("[", iso, "] ", level, " ", service, ": ", short),
        "iso_flex": say(iso, " ", level, " [", service, "] ", short),
        "access": say("10.0.0.1 - - [", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /', F.col("line_no"), ' HTTP/1.1" ', status, " 17"),
        "syslog": say(F.date_format("ts", "MMM d HH:mm:ss"), " host1 ", service, "[42]: ", prefix, short),
        "json": say('{"time":"', iso, '","level":"', F.lower("severity"), '","logger":"', service, '","msg":"', short, '"}'),
        "fallback": say("at some time ", F.lower("severity"), " in [", service, "] ", short),
    }[name]


EXPECTED = f"""
SELECT event_id AS line_no, '$' AS format, {{ts}} AS ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity, {{service}} AS service, {{message}} AS message FROM events"""
TIME_SQL, SERVICE_SQL, MESSAGE_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S')", "concat('svc', user_id % 7)", "concat('job ', event_id, ' done')"
SPECIAL = {
    "access": {"service": "'httpd'", "message": "concat('GET /', event_id, ' HTTP/1.1 ', CASE event_type WHEN 'error' THEN '503' WHEN 'purchase' THEN '404' ELSE '200' END, ' 17')"},
    "fallback": {"ts": "CAST(NULL AS VARCHAR)", "message": "concat('at some time ', CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END, ' in [svc', user_id % 7, '] job ', event_id, ' done')"},
}


def register(name: str) -> None:
    def run(spark, sf_dir):
        lines = entries(spark, sf_dir).select(line_of(name).alias("line"), "source_file", "line_no")
        found = incidents.parse(lines, year=2024)
        return found.select("line_no", "format", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "severity", "service", "message")

    QUERIES[f"log_parse_{name}"] = run
    ORACLE[f"log_parse_{name}"] = EXPECTED.replace("$", name).format(**({"ts": TIME_SQL, "service": SERVICE_SQL, "message": MESSAGE_SQL} | SPECIAL.get(name, {})))


for kind in FORMATS:
    register(kind)


@query("SELECT CAST(0 AS BIGINT) AS parse_failures")
def log_parse_failures(spark, sf_dir):
    lines = entries(spark, sf_dir).select(line_of("fallback").alias("line"), "source_file", "line_no")
    return incidents.parse_failures(incidents.parse(lines, year=2024))


NOW = datetime(2024, 1, 20, tzinfo=UTC)


@query(f"SELECT count(*) AS n FROM ({ENTRIES.sql}) WHERE ts BETWEEN '2024-01-13 00:00:00' AND '2024-01-20 00:00:00'")
def log_relative_range(spark, sf_dir):
    return incidents.within(entries(spark, sf_dir), *incidents.time_range("last_7d", NOW)).agg(F.count("*").alias("n"))


@query(f"""
WITH b AS ({HOURS}), s AS (SELECT avg(error) AS mean, stddev_pop(error) AS std, max(error) AS peak FROM b)
SELECT CAST(floor((peak - mean) / std * 100) AS BIGINT) AS score, CAST(floor(mean * 100) AS BIGINT) AS baseline FROM s""")
def log_anomaly_score(spark, sf_dir):
    """The highest z and the mean, in hundredths."""
    return incidents.anomaly(hours(spark, sf_dir)).select(*[F.floor(F.col(c) * 100).cast("long").alias(c) for c in ("score", "baseline")])


FEW = "SELECT count(DISTINCT date_trunc('hour', ts)) AS n_buckets, {} AS start, CAST(0 AS BIGINT) AS score FROM events WHERE ts < TIMESTAMP '2024-01-01 0{}:00:00'"


@query(f"{FEW.format('NULL', 3)} UNION ALL {FEW.format("strftime(min(date_trunc('hour', ts)), '%Y-%m-%dT%H:00:00Z')", 1)}")
def log_anomaly_few_buckets(spark, sf_dir):
    """The first three hours, if all have equally many errors, have no anomaly and no score; a single hour is its own start."""
    flat = hours(spark, sf_dir).withColumn("error", F.lit(4))
    first = [flat.filter(F.col("bucket") < f"2024-01-01T0{n}:00:00Z") for n in (3, 1)]
    rows = [incidents.anomaly(b).crossJoin(b.agg(F.count("*").alias("n_buckets"))).select("n_buckets", "start", F.col("score").cast("long").alias("score")) for b in first]
    return rows[0].unionByName(rows[1])


@query("""
SELECT max(n) AS peak, count(*) FILTER (n > 0) AS error_minutes, true AS has_fatal, 'CRITICAL' AS severity
FROM (SELECT count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY date_trunc('minute', ts))""")
def log_fatal_severity(spark, sf_dir):
    """Every ninth error is fatal, so the incident is critical whatever its peak."""
    fatal = F.when((F.col("severity") == "ERROR") & (F.col("line_no") % 9 == 0), "FATAL").otherwise(F.col("severity"))
    return incidents.classify(entries(spark, sf_dir).withColumn("severity", fatal))


@query("SELECT count(*) FILTER (event_id % 6 = 0) AS parse_failures FROM events")
def log_unparsed_lines(spark, sf_dir):
    """Lines without a time and a severity; every sixth has neither."""
    line = F.when(F.col("line_no") % 6 == 0, F.concat(F.lit("nothing to see in "), F.col("line_no"))).when(F.col("line_no") % 6 == 1, line_of("fallback")).otherwise(line_of("standard"))
    return incidents.parse_failures(incidents.parse(entries(spark, sf_dir).select(line.alias("line"), "source_file", "line_no"), year=2024))


KINDS = Given("""
SELECT CASE user_id % 8 WHEN 0 THEN 'ConnectionTimeout to db' WHEN 1 THEN 'NullPointerException in parser' WHEN 2 THEN 'java.lang.OutOfMemoryError: heap' WHEN 3 THEN 'request timed out after a while'
  WHEN 4 THEN 'HTTP 403 for a path' WHEN 5 THEN 'no space on disk' WHEN 6 THEN CONCAT('odd pattern ', REPEAT('x', 100)) ELSE 'rare' END AS pattern,
  CASE WHEN user_id % 8 = 6 THEN 1001 ELSE user_id % 500 END AS n, CONCAT('svc', CAST(user_id % 3 AS STRING)) AS service, event_id FROM {events}""")


@query(f"""
SELECT event_id, CASE {" ".join(f"WHEN starts_with(pattern, '{first}') THEN printf('{ADVICE[kind]}', {values})" for first, kind, values in (
    ("ConnectionTimeout", "connection", "n"), ("NullPointer", "null", "n, service || ', extra'"), ("java", "memory", "n"), ("request", "timeout", "n"), ("HTTP", "permission", "n"), ("no space", "storage", "n"), ("odd", "frequent", "n, left(pattern, 80)")))} END AS advice
FROM ({KINDS.sql})""")
def log_advice_kinds(spark, sf_dir):
    """One pattern for each kind of advice, and one for none."""
    return KINDS(spark, sf_dir).select("event_id", incidents.advice(F.col("pattern"), F.col("n"), F.array("service", F.lit("extra"))).alias("advice"))


@query(f"""
WITH m AS (SELECT max(n) AS peak, count(*) FILTER (n > 0) AS minutes FROM (SELECT count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY date_trunc('minute', ts)))
, p AS (SELECT pattern, n, row_number() OVER (ORDER BY n DESC, first_line) AS r FROM ({ERROR_PATTERNS}))
, s AS (SELECT concat('svc', user_id % 7) AS service, count(*) AS errors, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT count(*) AS total_lines_parsed, count(*) FILTER (severity = 'ERROR') AS total_errors, count(*) FILTER (severity = 'WARNING') AS total_warnings, count(*) FILTER (severity = 'INFO') AS total_info,
  CAST(0 AS BIGINT) AS parse_failures, (SELECT pattern FROM p WHERE r = 1) AS top_pattern, (SELECT n FROM p WHERE r = 1) AS top_count, (SELECT count(*) FROM p WHERE r <= 20) AS n_patterns,
  (SELECT service FROM s ORDER BY errors DESC, first LIMIT 1) AS first_service, (SELECT count(*) FROM s) AS n_services,
  (SELECT CASE WHEN peak > 1000 THEN 'CRITICAL' WHEN peak > 100 OR minutes > 10 THEN 'HIGH' WHEN peak > 10 THEN 'MEDIUM' ELSE 'LOW' END FROM m) AS severity, (SELECT peak FROM m) AS peak,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS "end"
FROM ({ENTRIES.sql})""")
def log_incident_report(spark, sf_dir):
    """The whole analysis of JSON lines, as far as a row shows its stored report."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.to_json(F.struct(iso.alias("time"), F.col("severity").alias("level"), F.col("service").alias("logger"), F.col("message").alias("msg")))
    report = incidents.analyze(entries(spark, sf_dir).select(line.alias("line"), "source_file", "line_no"), year=2024)
    r = report.document()
    report.release()
    top, first = r["top_errors"][0], r["affected_services"][0]
    row = dict(r["summary"]) | {
        "top_pattern": top["pattern"], "top_count": top["count"], "n_patterns": len(r["top_errors"]), "first_service": first["name"], "n_services": len(r["affected_services"]), "severity": r["severity"],
        "peak": r["anomaly_detection"]["peak_error_rate_per_min"], "start": r["time_range"]["start"][:19], "end": r["time_range"]["end"][:19],
    }
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'long'}" for k, v in row.items()))


@query(f"""
WITH e AS (SELECT {PATTERN} AS pattern, concat('svc', user_id % 7) AS service, ts < '{SPLIT}' AS a, event_id FROM events WHERE event_type = 'error')
, p AS (SELECT a, pattern FROM (SELECT a, pattern, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, min(event_id)) AS r FROM e GROUP BY a, pattern) WHERE r <= 20)
, s AS (SELECT DISTINCT a, service FROM e)
, t AS (SELECT (SELECT count(*) FROM (SELECT pattern FROM p WHERE a INTERSECT SELECT pattern FROM p WHERE NOT a)) AS pc, (SELECT count(DISTINCT pattern) FROM p) AS pn,
    (SELECT count(*) FROM (SELECT service FROM s WHERE a INTERSECT SELECT service FROM s WHERE NOT a)) AS sc, (SELECT count(DISTINCT service) FROM s) AS sn)
, x AS (SELECT *, CAST(round((100.0 * pc / pn * 0.6 + 100.0 * sc / sn * 0.3 + 10) * 10) AS BIGINT) AS similarity FROM t)
SELECT similarity, CASE WHEN similarity >= 800 THEN 'HIGH' WHEN similarity >= 500 THEN 'MODERATE' WHEN similarity >= 200 THEN 'LOW' ELSE 'MINIMAL' END AS level, pc AS n_common, pn - pc AS n_unique,
  (SELECT count(*) FROM e WHERE a) AS errors_in_a, (SELECT count(*) FROM e WHERE NOT a) AS errors_in_b FROM x""")
def log_compare_report(spark, sf_dir):
    """The comparison of the stored reports of both halves; both are of the same severity."""
    sides = []
    for half in (F.col("ts") < SPLIT, F.col("ts") >= SPLIT):
        iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        line = F.to_json(F.struct(iso.alias("time"), F.col("severity").alias("level"), F.col("service").alias("logger"), F.col("message").alias("msg")))
        report = incidents.analyze(entries(spark, sf_dir).filter(half).select(line.alias("line"), "source_file", "line_no"), year=2024)
        sides.append(report.document())
        report.release()
    c = incidents.comparison(*sides, ("a", "b"))
    patterns = c["pattern_comparison"]
    row = (
        round(c["similarity_score"] * 10), c["assessment"].split()[0], len(patterns["common_patterns"]), len(patterns["unique_to_a"]) + len(patterns["unique_to_b"]),
        c["incident_a"]["total_errors"], c["incident_b"]["total_errors"],
    )
    return spark.createDataFrame([row], "similarity long, level string, n_common long, n_unique long, errors_in_a long, errors_in_b long")
