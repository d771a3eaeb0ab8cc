"""Parsing, filters, anomalies, reports and comparisons of logs on small inputs."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import TIME_FORMATS, iso, minute, pattern_of, syslog_timestamp, timestamp
from tessera.operators import incidents

LINES = [
    ("2024-03-01 10:00:00.250 ERR [api] took 12 ms", ("2024-03-01T10:00:00.250000+00:00", "ERROR", "api", "took 12 ms", "standard")),
    ("[2024-03-01T10:00:00+05:30] WARN a.b-c: late", ("2024-03-01T04:30:00+00:00", "WARNING", "a.b-c", "late", "bracket_iso")),
    ("2024-03-01T10:00:00Z NOTICE svc: hello", ("2024-03-01T10:00:00+00:00", "INFO", "svc", "hello", "iso_flex")),
    ("2024-03-01T10:00:00Z DEBUG no service here", ("2024-03-01T10:00:00+00:00", "DEBUG", "", "no service here", "iso_flex")),
    ('10.0.0.1 - bob [01/Mar/2024:10:00:00 +0200] "GET /x HTTP/1.1" 503 17 "-" "curl"', ("2024-03-01T08:00:00+00:00", "ERROR", "httpd", "GET /x HTTP/1.1 503 17", "access")),
    ("Mar  1 10:00:00 host cron[7]: CRIT: disk full", ("2024-03-01T10:00:00+00:00", "CRITICAL", "cron", "disk full", "syslog")),
    ("Mar 11 10:00:00 host cron: done", ("2024-03-11T10:00:00+00:00", "INFO", "cron", "done", "syslog")),
    ('{"@timestamp":"2024-03-01T10:00:00Z","log_level":"fatal","app":"x","text":"boom","time":""}', ("2024-03-01T10:00:00+00:00", "FATAL", "x", "boom", "json")),
    ('{"msg":null,"level":null,"source":null}', (None, "INFO", "", '{"msg":null,"level":null,"source":null}', "json")),
    ("{not json} error", (None, "ERROR", "app", "{not json} error", "fallback")),
    ("  something [worker] warned  ", (None, "WARNING", "worker", "something [worker] warned", "fallback")),
    ("plain", (None, "UNKNOWN", "app", "plain", "fallback")),
]


def lines_of(spark, lines):
    return spark.createDataFrame([(x, "/logs/app.log", i) for i, x in enumerate(lines)], "line string, source_file string, line_no long")


def test_formats(spark):
    found = incidents.parse(lines_of(spark, [x for x, _ in LINES] + ["", "   "]), 2024)
    rows = found.select("line_no", iso(found["ts"]).alias("ts"), "severity", "service", "message", "format").orderBy("line_no").collect()
    assert [tuple(r)[1:] for r in rows] == [e for _, e in LINES]
    assert incidents.parse_failures(found).first()[0] == 1


def test_message_patterns(spark):
    text = "at 2024-01-02T03:04:05.6Z a.b@c.de 123e4567-e89b-12d3-a456-426614174000 1.2.3.4:8080 1:2:3:4:5:6:7:8 0xFF /var/log/x.log 17 ms"
    df = spark.createDataFrame([(text,)], "m string")
    assert df.select(pattern_of(df["m"])).first()[0] == "at {timestamp} {email} {uuid} {ip}:{port} {ipv6} {hex} {path} {n} ms"


def test_times(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02",), ("junk",), ("02/Jan/2024:03:04:05 -0100",)], "t string")
    assert [r[0] for r in df.select(iso(timestamp(df["t"]))).collect()] == ["2024-01-02T03:04:05+00:00", "2024-01-02T00:00:00+00:00", None, "2024-01-02T04:04:05+00:00"]
    assert df.select(minute(syslog_timestamp(df["t"].substr(100, 1), 2024))).first()[0] is None


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, (None, None)), ("nonsense", (None, None)), ("last_5weeks", (None, None)),
        ("last_30minutes", (datetime(2024, 1, 19, 23, 30, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC))),
        ("last_2d", (datetime(2024, 1, 18, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC))),
        ("2024-01-01/2024-01-02T03:00:00+01:00", (datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 2, 2, tzinfo=UTC))),
        ("2024-01-01/bad", (datetime(2024, 1, 1, tzinfo=UTC), None)),
    ],
)
def test_time_ranges(text, expected):
    assert incidents.time_range(text, datetime(2024, 1, 20, tzinfo=UTC)) == expected


def buckets_of(spark, errors):
    return spark.createDataFrame([(f"2024-01-01T00:{i:02}:00Z", e, e, 0, 0) for i, e in enumerate(errors)], "bucket string, total long, error long, warning long, info long")


@pytest.mark.parametrize(
    ("errors", "start", "flagged"),
    [([], None, 0), ([5], "2024-01-01T00:00:00Z", 0), ([1] * 9, None, 0), ([0, 0, 0, 0, 99], None, 0), ([0] * 9 + [9], "2024-01-01T00:09:00Z", 1)],
)
def test_anomalies(spark, errors, start, flagged):
    buckets = buckets_of(spark, errors)
    found = incidents.anomaly(buckets).first()
    assert found["start"] == start and found["peak"] == max(errors, default=0)
    assert incidents.flags(buckets).filter("anomalous").count() == flagged


@pytest.mark.parametrize(("minutes", "level"), [([5] * 5, "LOW"), ([11], "MEDIUM"), ([1] * 11, "HIGH"), ([101], "HIGH"), ([1001], "CRITICAL")])
def test_levels(spark, minutes, level):
    peaks = spark.createDataFrame([(max(minutes), len(minutes), False), (1, 1, True)], "p long, m long, f boolean")
    assert [r[0] for r in peaks.select(incidents.incident_severity(peaks["p"], peaks["m"], peaks["f"])).collect()] == [level, "CRITICAL"]


def test_reports_and_their_comparison(spark):
    lines = [f"2024-03-01 10:{i % 20:02}:00 ERROR [db] connection timeout after {i} ms" for i in range(40)] + ["2024-03-01 10:30:00 ERROR [web] disk full", "2024-03-01 11:00:00 INFO [web] fine", ""]
    report = incidents.analyze(lines_of(spark, lines), "test", year=2024)
    a = report.as_dict()
    assert (a["severity"], a["summary"]["errors"], a["summary"]["infos"], a["summary"]["total_lines"]) == ("HIGH", 41, 1, 43)
    assert [(e["pattern"], e["n"], e["services"], e["sample"]) for e in a["top_errors"]] == [("connection timeout after {n} ms", 40, ["db"], "connection timeout after 0 ms"), ("disk full", 1, ["web"], "disk full")]
    assert a["services"] == [{"service": "db", "errors": 40}, {"service": "web", "errors": 1}] and len(a["recommendations"]) == len(set(a["recommendations"])) >= 4
    b = incidents.analyze(lines_of(spark, lines[:40]), "test", year=2024).as_dict()
    both = incidents.compare(a, b)
    assert (both["similarity_score"], both["band"]) == (55.0, "MODERATE") and both["unique_to_a"] == [{"pattern": "disk full", "count": 1}]
    assert incidents.compare(a, a)["similarity_score"] == 100.0
    nothing = {"top_errors": [], "services": [], "severity": "LOW"}
    assert incidents.compare(nothing, nothing)["similarity_score"] == 10.0


def test_nothing_at_all(spark):
    report = incidents.analyze(lines_of(spark, [""]), year=2024).as_dict()
    assert report["severity"] == "LOW" and report["summary"]["total"] == 0 and report["top_errors"] == []


def test_first_occurrences(spark):
    entries = incidents.parse(lines_of(spark, ["ERROR a 1", "ERROR a 2", "ERROR b 1"]), 2024)
    assert sorted(r["line_no"] for r in incidents.first_occurrences(entries).collect()) == [0, 2]


def test_comparison_gathers_no_patterns(spark):
    """The query counts by pattern; no row holds all patterns."""
    from tessera.plans.incidents import log_compare_jaccard
    from tests.against import TABLES

    plan = log_compare_jaccard(spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "Join" not in plan


def test_times_in_their_formats(spark):
    """Trying a text only in formats whose form it has gives what trying all of them in turn gives."""
    days, clocks = ["2024-01-02", "2024/01/02", "24-01-02", "2024-13-02", "+12024-01-02", "2024-1-2"], ["", " 03:04:05", "T03:04:05", "t03:04:05", "T3:04:05", "  03:04:05", " 03:04", "T25:04:05", ":03:04:05"]
    ends = ["", ".1", ".123", ".123456", ".1234567", "Z", "z", "+01:30", "-0130", "+01", ".5Z", ".123456+01:30", ".5-0130", " +0000", " x", "+01:30:10"]
    texts = [d + c + e for d in days for c in clocks for e in ends] + ["02/Jan/2024:03:04:05 +0100", "02/jan/2024:03:04:05 -0000", "", "x", "20240102", " 2024-01-02 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    clean = F.regexp_replace(F.trim("t"), r"\s+", " ")
    plain = F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f, _ in TIME_FORMATS])
    rows = df.select("t", timestamp(df["t"]).cast("string").alias("a"), plain.cast("string").alias("b")).collect()
    assert [r["t"] for r in rows if r["a"] != r["b"]] == [] and sum(r["b"] is not None for r in rows) > 20


def test_json_lines_are_read_once(spark):
    """The first non-empty value of the keys in their order, as text; no expression reads a line for each key."""
    lines = [
        '{"ts": "2024-01-02 03:04:05", "timestamp": "", "level": "0", "severity": "warn", "app": "a", "service": null, "text": "x", "msg": {"k": [1, 2.50]}}', '{"message": 7, "@timestamp": "2024-01-02T03:04:05Z", "source": true}',
        "{'level': 'error'}", '{"level": "error"', '{}', '{"level": "info", "level": "error"}',
    ]
    df = spark.createDataFrame([(x, "/l/app.log", i) for i, x in enumerate(lines)], "line string, source_file string, line_no long")
    found = incidents.parse(df, 2024)
    rows = [(r["format"], r["severity"], r["service"], r["message"]) for r in found.orderBy("line_no").collect()]
    assert rows[:2] == [("json", "WARNING", "a", '{"k":[1,2.5]}'), ("json", "INFO", "true", "7")] and rows[4] == ("json", "INFO", "", "{}")
    assert [r[:2] for r in (rows[2], rows[3], rows[5])] == [("fallback", "ERROR")] * 3
    assert all(r["ts"] is not None for r in found.filter("line_no < 2").collect())
    assert "get_json_object" not in found._jdf.queryExecution().optimizedPlan().toString()
