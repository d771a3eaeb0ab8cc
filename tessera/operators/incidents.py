"""Log incidents: parsing lines of many formats, error patterns, timelines, anomalies, severity, comparison.

Entries have ts, severity, service, message, raw, source_file and line_no; (source_file, line_no) is the order of the
corpus. Parsing is one projection; patterns, services and the timeline are aggregations with partial steps, so a pattern
that a third of all lines share costs one row for each task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.columns import extract, iso, minute, pattern_of, quoted, severity, severity_rank, syslog_timestamp, timestamp

ERRORS = ("ERROR", "CRITICAL", "FATAL")
Z_THRESHOLD = 2.0
TOP_PATTERNS = 20


# Parsing.


#: Keys of JSON lines by what they hold, in order of preference.
JSON_KEYS = {
    "ts": ["timestamp", "time", "@timestamp", "ts"], "severity": ["level", "severity", "loglevel", "log_level"],
    "service": ["service", "logger", "app", "source"], "message": ["message", "msg", "text"],
}


def with_json(lines: DataFrame) -> DataFrame:
    """``lines`` with __json: for JSON lines a struct of the first non-empty value of each of JSON_KEYS, else null. A line is read once."""
    keys = [k for own in JSON_KEYS.values() for k in own]
    of_json = F.when(F.col("line").rlike(fixed.LINE_JSON) & F.try_parse_json("line").isNotNull(), F.col("line"))
    read = lines.withColumn("__json_line", of_json).select("*", F.json_tuple("__json_line", *keys).alias(*[f"__{k}" for k in keys]))
    first = lambda own: F.coalesce(*[F.when(~F.col(f"`__{k}`").isin("", "0"), F.col(f"`__{k}`")) for k in own])
    found = F.when(F.col("__json_line").isNotNull(), F.struct(*[first(own).alias(name) for name, own in JSON_KEYS.items()]))
    return read.select(*[quoted(c) for c in lines.columns], found.alias("__json"))


def parsed(line: Column, source_file: Column, year: int, json: Column) -> Column:
    """struct(ts, severity, service, message, format) of a line, by the first format that fits; ``json`` is that of ``with_json``."""
    entry = lambda ts, level, service, message, name: F.struct(ts.alias("ts"), level.alias("severity"), service.alias("service"), message.alias("message"), F.lit(name).alias("format"))
    group = lambda pattern, i: F.regexp_extract(line, pattern, i)
    empty = F.lit("")
    from_json = entry(timestamp(json["ts"]), severity(F.coalesce(json["severity"], F.lit("INFO"))), F.coalesce(json["service"], empty), F.coalesce(json["message"], line), "json")
    standard = entry(timestamp(group(fixed.LINE_STANDARD, 1)), severity(group(fixed.LINE_STANDARD, 2)), F.trim(group(fixed.LINE_STANDARD, 3)), F.trim(group(fixed.LINE_STANDARD, 4)), "standard")
    bracket = entry(timestamp(group(fixed.LINE_BRACKET_ISO, 1)), severity(group(fixed.LINE_BRACKET_ISO, 2)), F.trim(group(fixed.LINE_BRACKET_ISO, 3)), F.trim(group(fixed.LINE_BRACKET_ISO, 4)), "bracket_iso")
    either = F.coalesce(extract(line, fixed.LINE_ISO_FLEX, 3), extract(line, fixed.LINE_ISO_FLEX, 4), empty)
    flex = entry(timestamp(group(fixed.LINE_ISO_FLEX, 1)), severity(group(fixed.LINE_ISO_FLEX, 2)), F.trim(either), F.trim(group(fixed.LINE_ISO_FLEX, 5)), "iso_flex")
    status = group(fixed.LINE_ACCESS, 4)
    level = F.when(status >= "500", "ERROR").when(status >= "400", "WARNING").otherwise("INFO")
    access = entry(timestamp(group(fixed.LINE_ACCESS, 2)), level, F.lit("httpd"), F.concat_ws(" ", group(fixed.LINE_ACCESS, 3), status, group(fixed.LINE_ACCESS, 5)), "access")
    said = F.trim(group(fixed.LINE_SYSLOG, 5))
    prefixed = said.rlike(fixed.SYSLOG_SEVERITY)
    syslog = entry(
        syslog_timestamp(group(fixed.LINE_SYSLOG, 1), year),
        F.when(prefixed, severity(F.regexp_extract(said, fixed.SYSLOG_SEVERITY, 1))).otherwise("INFO"),
        F.trim(group(fixed.LINE_SYSLOG, 3)),
        F.when(prefixed, F.trim(F.regexp_extract(said, fixed.SYSLOG_SEVERITY, 2))).otherwise(said),
        "syslog",
    )
    upper = F.upper(line)
    word = F.coalesce(*[F.when(F.contains(upper, F.lit(k)), severity(F.lit(k))) for k in fixed.FALLBACK_SEVERITIES], F.lit("UNKNOWN"))
    stem = F.regexp_extract(source_file, r"([^/]+?)(?:\.[^./]*)?$", 1)
    service = F.coalesce(extract(line, fixed.LINE_SERVICE), F.nullif(stem, empty), empty)
    fallback = entry(F.lit(None).cast("timestamp"), word, service, F.trim(line), "fallback")
    return (
        F.when(json.isNotNull(), from_json).when(line.rlike(fixed.LINE_STANDARD), standard).when(line.rlike(fixed.LINE_BRACKET_ISO), bracket).when(line.rlike(fixed.LINE_ISO_FLEX), flex)
        .when(line.rlike(fixed.LINE_ACCESS), access).when(line.rlike(fixed.LINE_SYSLOG), syslog).otherwise(fallback)
    )


def parse(lines: DataFrame, year: int | None = None) -> DataFrame:
    """Entries of ``lines`` (line, source_file, line_no); blank lines have none. ``year``: for formats without one."""
    year = year or datetime.now(UTC).year
    worded = lines.filter(F.trim("line") != "")
    entry = parsed(F.col("line"), F.col("source_file"), year, F.col("__json"))
    return with_json(worded).withColumn("entry", entry).select("entry.*", F.col("line").alias("raw"), "source_file", "line_no")


def parse_failures(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if(F.col("ts").isNull() & (F.col("severity") == "UNKNOWN")).alias("parse_failures"))


# Filters.


def time_range(text: str | None, now: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """``start/end`` in ISO form, or ``last_<n><m|h|d>``; other text has no bounds."""
    if not text:
        return None, None
    if "/" in text and not text.startswith("last_"):
        return tuple(instant(x) for x in text.split("/", 1))
    if m := re.match(r"last_(\d+)([mhd])", text.lower()):
        now = now or datetime.now(UTC)
        return now - timedelta(**{{"m": "minutes", "h": "hours", "d": "days"}[m[2]]: int(m[1])}), now
    return None, None


def instant(text: str) -> datetime | None:
    try:
        found = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    return found.astimezone(UTC) if found.tzinfo else found.replace(tzinfo=UTC)


def within(entries: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Entries from ``start`` to ``end``, both included; entries without a time only where there is no bound."""
    if start is not None:
        entries = entries.filter(F.col("ts") >= F.lit(start))
    return entries.filter(F.col("ts") <= F.lit(end)) if end is not None else entries


def at_least(entries: DataFrame, threshold: str) -> DataFrame:
    """Entries of the severity ``threshold`` or a higher one."""
    return entries.filter(severity_rank(F.col("severity")) >= severity_rank(severity(F.lit(threshold))))


# Aggregations.


def is_error() -> Column:
    return F.col("severity").isin(*ERRORS)


def severity_counts(entries: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos, unknown, total, any fatal, first and last time."""
    return entries.agg(
        F.count_if(is_error()).alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
        F.count_if(F.col("severity").isin("INFO", "DEBUG")).alias("infos"),
        F.count_if(F.col("severity") == "UNKNOWN").alias("unknown"),
        F.count("*").alias("total"),
        F.coalesce(F.bool_or(F.col("severity") == "FATAL"), F.lit(False)).alias("has_fatal"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def error_patterns(entries: DataFrame) -> DataFrame:
    """pattern, n, first_seen, last_seen, services, sample and the place of its first line, for errors."""
    place = F.struct("source_file", "line_no")
    errors = entries.filter(is_error()).withColumn("pattern", pattern_of(F.col("message")))
    return errors.groupBy("pattern").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.array_sort(F.collect_set(F.nullif("service", F.lit("")))).alias("services"),
        F.min_by("message", place).alias("sample"),
        F.min(place).alias("first_place"),
    )


def top_patterns(patterns: DataFrame, n: int = TOP_PATTERNS) -> DataFrame:
    """The commonest patterns, those seen first among equals."""
    return patterns.orderBy(F.desc("n"), "first_place").limit(n)


def timeline(entries: DataFrame, bucket: Column | None = None) -> DataFrame:
    """bucket, total, error, warning, info; buckets without lines have no row."""
    info = F.col("severity").isin("INFO", "DEBUG")
    counts = [F.count("*").alias("total"), F.count_if(is_error()).alias("error"), F.count_if(F.col("severity") == "WARNING").alias("warning"), F.count_if(info).alias("info")]
    return entries.filter("ts is not null").groupBy((minute(F.col("ts")) if bucket is None else bucket).alias("bucket")).agg(*counts)


def fill_gaps(buckets: DataFrame) -> DataFrame:
    """``timeline`` by minutes with a row of zeros for each quiet minute between the first and the last."""
    form = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    edges = buckets.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).filter("a is not null")
    every = edges.select(F.explode(F.sequence(F.to_timestamp("a", form), F.to_timestamp("b", form), F.expr("interval 1 minute"))).alias("t")).select(minute(F.col("t")).alias("bucket"))
    joined = every.join(buckets, "bucket", "left")
    return joined.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "error", "warning", "info")])


def affected_services(entries: DataFrame) -> DataFrame:
    """service and errors, most first, those seen first among equals."""
    named = entries.filter(is_error() & (F.col("service") != ""))
    counted = named.groupBy("service").agg(F.count("*").alias("errors"), F.min(F.struct("source_file", "line_no")).alias("first_place"))
    return counted.orderBy(F.desc("errors"), "first_place").select("service", "errors")


# Anomalies.


def flags(buckets: DataFrame) -> DataFrame:
    """``buckets`` with anomalous: the error count is more than Z_THRESHOLD population deviations above the mean.

    With integers throughout, so that results do not depend on the order of sums: for n buckets with the sum s and the sum
    of squares q, z > 2 when n e > s and (n e - s)^2 > 4 (n q - s^2).
    """
    e = F.col("error").cast("decimal(18,0)")
    stats = buckets.agg(F.count("*").cast("decimal(18,0)").alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q"))
    above = F.col("n") * e - F.col("s")
    flagged = (above > 0) & (above * above > F.lit(int(Z_THRESHOLD**2)) * (F.col("n") * F.col("q") - F.col("s") * F.col("s")))
    # One row of statistics, whatever the input.
    return buckets.join(F.broadcast(stats)).withColumn("anomalous", F.coalesce(flagged, F.lit(False))).drop("n", "s", "q")


def anomaly(buckets: DataFrame) -> DataFrame:
    """One row: start (first anomalous bucket), score (highest z, 0 at least), baseline (mean) and peak of the errors."""
    stats = buckets.agg(F.count("*").alias("n"), F.avg("error").alias("mean"), F.stddev_pop("error").alias("std"), F.max("error").alias("peak"), F.min("bucket").alias("only"))
    z = F.when(F.col("std") > 0, (F.col("error") - F.col("mean")) / F.col("std")).otherwise(0.0)
    each = buckets.join(F.broadcast(stats)).withColumn("z", z)
    found = each.agg(F.min(F.when(F.col("z") > Z_THRESHOLD, F.col("bucket"))).alias("start"), F.greatest(F.max("z"), F.lit(0.0)).alias("score"))
    both = stats.join(F.broadcast(found))
    few = F.col("n") < 2
    return both.select(
        F.when(few, F.col("only")).otherwise(F.col("start")).alias("start"),
        F.when(few, F.lit(0.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.coalesce("mean", F.lit(0.0)).alias("baseline"),
        F.coalesce("peak", F.lit(0)).alias("peak"),
    )


def incident_severity(peak: Column, error_minutes: Column, has_fatal: Column) -> Column:
    return (
        F.when(has_fatal | (peak > 1000), "CRITICAL").when((peak > 100) | (error_minutes > 10), "HIGH").when(peak > 10, "MEDIUM").otherwise("LOW")
    )


def classify(entries: DataFrame) -> DataFrame:
    """One row: peak, error_minutes, has_fatal, severity."""
    peaks = timeline(entries).agg(F.coalesce(F.max("error"), F.lit(0)).alias("peak"), F.count_if(F.col("error") > 0).alias("error_minutes"))
    fatal = entries.agg(F.coalesce(F.bool_or(F.col("severity") == "FATAL"), F.lit(False)).alias("has_fatal"))
    both = peaks.join(F.broadcast(fatal))
    return both.withColumn("severity", incident_severity(F.col("peak"), F.col("error_minutes"), F.col("has_fatal")))


# Recommendations.


def advice(pattern: Column, n: Column, services: Column) -> Column:
    """What to do about an error pattern, or null: the advice of the first kind in the table that it is of."""
    lower, named = F.lower(pattern), F.array_join(services, ", ")
    has = lambda text, *words: F.array_contains(F.array(*[F.contains(text, F.lit(w)) for w in words]), True)
    kinds = {
        "connection": (has(pattern, "ConnectionTimeout") | (has(lower, "connection") & has(lower, "timeout")), [n]),
        "null": (has(pattern, "NullPointer", "NoneType") | has(lower, "null"), [n, named]),
        "memory": (has(pattern, "OutOfMemory", "MemoryError") | has(lower, "heap"), [n]),
        "timeout": (has(pattern, "Timeout") | has(lower, "timed out"), [n]),
        "permission": (has(pattern, "Permission", "Forbidden", "403"), [n]),
        "storage": (has(lower, "disk", "storage") | has(pattern, "ENOSPC"), [n]),
        "frequent": (n > 1000, [n, F.substring(pattern, 1, 80)]),
    }
    return F.coalesce(*[F.when(fits, F.format_string(fixed.ADVICE[kind], *values)) for kind, (fits, values) in kinds.items()])


def recommendations(top: list, start: str | None, services: list[str], level: str) -> list[str]:
    """Advice of the top patterns (rows with ``advice``), then on the start, the services and the severity; no repeats."""
    said = [r["advice"] for r in top[:5] if r["advice"]]
    if start:
        said.append(fixed.START_ADVICE.format(start))
    if first := services[:3]:
        said.append(fixed.SERVICES_ADVICE[len(first) > 1].format(", ".join(first)))
    said += [fixed.SEVERITY_ADVICE[level]] if level in fixed.SEVERITY_ADVICE else []
    return list(dict.fromkeys(said))


# Reports.


@dataclass
class Report:
    environment: str
    severity: str
    summary: dict
    top_errors: list[dict]
    anomaly: dict
    services: list[dict]
    recommendations: list[str]
    patterns: DataFrame
    timeline: DataFrame
    entries: DataFrame

    def as_dict(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("patterns", "timeline", "entries")}

    def release(self) -> None:
        """Let go of the entries that are kept for ``patterns`` and ``timeline``."""
        self.entries.unpersist()

    def document(self, output_files: dict | None = None) -> dict:
        """The report in the form in which it is stored and compared."""
        s, a = self.summary, self.anomaly
        time = lambda t: t.replace(tzinfo=t.tzinfo or UTC).isoformat() if t else None
        return {
            "environment": self.environment,
            "time_range": {"start": time(s["first_seen"]), "end": time(s["last_seen"])},
            "severity": self.severity,
            "summary": {"total_lines_parsed": s["total_lines"], "total_errors": s["errors"], "total_warnings": s["warnings"], "total_info": s["infos"], "parse_failures": s["parse_failures"]},
            "top_errors": [
                {"pattern": e["pattern"], "count": e["n"], "first_seen": e["first_seen"], "last_seen": e["last_seen"], "affected_services": e["services"], "sample_message": e["sample"]}
                for e in self.top_errors
            ],
            "anomaly_detection": {"suspected_incident_start": a["start"], "anomaly_score": a["score"], "baseline_error_rate_per_min": a["baseline"], "peak_error_rate_per_min": a["peak"]},
            "affected_services": [{"name": x["service"], "error_count": x["errors"]} for x in self.services],
            "recommendations": self.recommendations,
            "output_files": output_files or {},
        }


def analyze(lines: DataFrame, environment: str = "production", time: str | None = None, threshold: str | None = None, now: datetime | None = None, year: int | None = None) -> Report:
    """An incident report of log lines. Only the top patterns, services and single rows of statistics come to the driver.

    A null line stands for a file that can't be read and counts as a failure to parse.
    """
    every = parse(lines, year).persist()
    n_lines, unreadable = lines.agg(F.count("line"), F.count_if(F.col("line").isNull())).first()
    failures = parse_failures(every).first()[0] + unreadable
    entries = within(every, *time_range(time, now))
    entries = at_least(entries, threshold) if threshold else entries
    counts = severity_counts(entries).first().asDict()
    patterns, buckets = error_patterns(entries), timeline(entries)
    shown = top_patterns(patterns).withColumn("advice", advice(F.col("pattern"), F.col("n"), F.col("services")))
    top = shown.withColumns({"first_seen": iso(F.col("first_seen")), "last_seen": iso(F.col("last_seen"))}).drop("first_place").collect()
    services = [r.asDict() for r in affected_services(entries).limit(TOP_PATTERNS).collect()]
    found, level = anomaly(buckets).first().asDict(), classify(entries).first()["severity"]
    found["score"], found["baseline"] = round(found["score"], 2), round(found["baseline"], 2)
    said = recommendations(top, found["start"], [s["service"] for s in services], level)
    summary = counts | {"total_lines": n_lines, "parse_failures": failures, "unreadable_files": unreadable}
    return Report(environment, level, summary, [{k: v for k, v in r.asDict().items() if k != "advice"} for r in top], found, services, said, patterns, buckets, every)


# Comparison.


def jaccard_percent(a: Column, b: Column) -> Column:
    """Shared share of two arrays in percent; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) * 100.0 / union).otherwise(0.0)


def similarity(patterns: float, services: float, same_severity: bool) -> float:
    return round(patterns * 0.6 + services * 0.3 + (100 if same_severity else 0) * 0.1, 1)


def band(score: Column) -> Column:
    return F.when(score >= 80, "HIGH").when(score >= 50, "MODERATE").when(score >= 20, "LOW").otherwise("MINIMAL")


def compare_patterns(a: DataFrame, b: DataFrame) -> DataFrame:
    """pattern, count_in_a, count_in_b and side (both, a or b) of two sets of patterns (pattern, n)."""
    left, right = a.select("pattern", F.col("n").alias("count_in_a")), b.select("pattern", F.col("n").alias("count_in_b"))
    side = F.when(F.col("count_in_a").isNull(), "b").when(F.col("count_in_b").isNull(), "a").otherwise("both")
    return left.join(right, "pattern", "full_outer").select("pattern", F.coalesce("count_in_a", F.lit(0)).alias("count_in_a"), F.coalesce("count_in_b", F.lit(0)).alias("count_in_b"), side.alias("side"))


def compare(a: dict, b: dict) -> dict:
    """Comparison of two reports (as ``Report.as_dict`` gives them), by their top patterns, services and severities."""
    share = lambda x, y: 100 * len(x & y) / len(x | y) if x | y else 0.0
    counts = [{e["pattern"]: e["n"] for e in reversed(r["top_errors"])} for r in (a, b)]
    named = [{s["service"] for s in r["services"]} for r in (a, b)]
    patterns, services, same = share(counts[0].keys(), counts[1].keys()), share(*named), a["severity"] == b["severity"]
    score = similarity(patterns, services, same)
    level = next(name for least, name in ((80, "HIGH"), (50, "MODERATE"), (20, "LOW"), (-1, "MINIMAL")) if score >= least)
    return {
        "similarity_score": score,
        "band": level,
        "common_patterns": [{"pattern": p, "count_in_a": counts[0][p], "count_in_b": counts[1][p]} for p in sorted(counts[0].keys() & counts[1].keys())],
        "unique_to_a": [{"pattern": p, "count": counts[0][p]} for p in sorted(counts[0].keys() - counts[1].keys())],
        "unique_to_b": [{"pattern": p, "count": counts[1][p]} for p in sorted(counts[1].keys() - counts[0].keys())],
        "common_services": sorted(named[0] & named[1]),
        "services_only_in_a": sorted(named[0] - named[1]),
        "services_only_in_b": sorted(named[1] - named[0]),
        "same_severity": same,
    }


def of_document(report: dict) -> dict:
    """What ``compare`` reads of a stored report (``Report.document``); parts that are missing count as empty."""
    return {
        "severity": report.get("severity", "UNKNOWN"),
        "top_errors": [{"pattern": e["pattern"], "n": e.get("count", 0)} for e in report.get("top_errors", [])],
        "services": [{"service": x["name"]} for x in report.get("affected_services", [])],
    }


def comparison(a: dict, b: dict, names: tuple[str, str]) -> dict:
    """The comparison of two stored reports as a report of its own: both sides, their overlaps, and an assessment."""
    sides = [of_document(x) for x in (a, b)]
    found = compare(*sides)
    known = [({e["pattern"] for e in x["top_errors"]}, {e["service"] for e in x["services"]}) for x in sides]
    percent = lambda k: round(100 * len(known[0][k] & known[1][k]) / max(1, len(known[0][k] | known[1][k])), 1)
    summary = lambda x, i: {
        "file": names[i], "environment": x.get("environment", "unknown"), "time_range": x.get("time_range", {}), "severity": sides[i]["severity"],
        "total_errors": x.get("summary", {}).get("total_errors", 0), "num_error_patterns": len(known[i][0]), "num_affected_services": len(known[i][1]),
    }
    return {
        "similarity_score": found["similarity_score"],
        "assessment": fixed.ASSESSMENTS[found["band"]],
        "incident_a": summary(a, 0),
        "incident_b": summary(b, 1),
        "pattern_comparison": {k: found[k] for k in ("common_patterns", "unique_to_a", "unique_to_b")} | {"pattern_similarity_pct": percent(0)},
        "service_comparison": {
            "common_services": found["common_services"], "unique_to_a": found["services_only_in_a"], "unique_to_b": found["services_only_in_b"], "service_similarity_pct": percent(1),
        },
        "severity_comparison": {"incident_a": sides[0]["severity"], "incident_b": sides[1]["severity"], "same_severity": found["same_severity"]},
    }


def first_occurrences(entries: DataFrame) -> DataFrame:
    """The first entry of each pattern, in the order of the corpus."""
    own = entries.withColumn("pattern", pattern_of(F.col("message")))
    nth = F.row_number().over(Window.partitionBy("pattern").orderBy("source_file", "line_no"))
    return own.withColumn("nth", nth).filter("nth = 1").drop("nth")
