"""The five analyses from files to files: what a user calls who has paths rather than frames.

Each returns a plain dictionary. Failures that can be foreseen (a missing file, an unknown format, no records) come back
as ``status`` "error" with a message; others are raised. Outputs lie beside the inputs unless ``output`` names a folder.
"""

from __future__ import annotations

import os
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import incidents, invoices, quality, records
from tessera.sources import documents, files, logs, tabular
from tessera.sources.paths import exists
from tessera.sources import records as sources

FORMATS = ("csv", "json", "excel")


def failed(message: str) -> dict:
    return {"status": "error", "error": message}


def beside(path: str, name: str, output: str | None) -> str:
    return os.path.join(output or os.path.dirname(path.rstrip("/")), name)


def tried(write, *args) -> str:
    """A path that was written, or why it was not."""
    try:
        write(*args)
        return args[-1]
    except Exception as e:  # an output that fails doesn't void the analysis
        return f"not written: {type(e).__name__}: {e}"


def profile_dataset(spark: SparkSession, path: str, cleaned: bool = True, output: str | None = None) -> dict:
    """Profile, faults, score and recommendations of a table, stored as JSON, and a cleaned copy as CSV."""
    if not exists(spark, path):
        return failed(f"no such file: {path}")
    try:
        df, place = tabular.read_placed_table(spark, path)
    except ValueError as e:
        return failed(str(e))
    profile = quality.profile(df, place)
    found = asdict(profile)
    if cleaned and found["rows"]:
        found["cleaned_file"] = tried(files.write_csv, quality.clean(df.drop(place)), beside(path, os.path.basename(files.cleaned_name(path)), output))
    found["report_file"] = tried(files.write_profile, spark, profile, found.get("cleaned_file"), beside(path, os.path.basename(files.profile_name(path)), output))
    return {"status": "success"} | found


def analyze_logs(spark: SparkSession, path: str, environment: str = "production", time_range: str | None = None, severity_threshold: str | None = None, output: str | None = None, **more) -> dict:
    """An incident report of log files, a ZIP archive or a directory, with its tables as CSV."""
    if not exists(spark, path):
        return failed(f"no such file: {path}")
    lines = logs.read_logs(spark, path)
    if lines.filter("line is not null").isEmpty():
        return failed("no log lines found")
    report = incidents.analyze(lines, environment, time_range, severity_threshold, **more)
    if not report.summary["total"]:
        return failed("no log entries in the time range")
    names = {"error_summary": "error_summary.csv", "timeline": "timeline.csv", "report": "incident_report.json"}
    at = {k: beside(path, n, output) for k, n in names.items()}
    written = {"error_summary": tried(files.write_error_summary, report.patterns, at["error_summary"]), "timeline": tried(files.write_timeline, report.timeline, at["timeline"])}
    names_of = {k: os.path.basename(x) if x == at[k] else x for k, x in written.items()}
    written["report"] = tried(files.write_report, report, names_of | {"incident_report": names["report"]}, at["report"])
    report.release()
    return {"status": "success", "unreadable_files": report.summary["unreadable_files"]} | report.as_dict() | {"output_files": written}


def compare_incidents(spark: SparkSession, path_a: str, path_b: str) -> dict:
    """Comparison of two reports that ``analyze_logs`` wrote."""
    for path in (path_a, path_b):
        if not exists(spark, path):
            return failed(f"no such file: {path}")
    try:
        a, b = (sources.read_reports(spark, p)[0] for p in (path_a, path_b))
    except ValueError as e:
        return failed(f"not a report: {e}")
    return {"status": "success"} | incidents.comparison(a, b, (path_a, path_b))


def transform_records(spark: SparkSession, path: str, config: str | None = None, enrichers: list[str] | None = None, output_format: str = "csv", flatten_depth: int = 10, output: str | None = None) -> dict:
    """Nested JSON records as a flat table: CSV, JSON or Excel."""
    began = time.perf_counter()
    if output_format not in FORMATS:
        return failed(f"unknown output format {output_format!r}; use one of {', '.join(FORMATS)}")
    for p in (path, *([config] if config else [])):
        if not exists(spark, p):
            return failed(f"no such file: {p}")
    try:
        found = sources.read_records(spark, path)
    except ValueError as e:
        return failed(f"not JSON: {e}")
    if not found.columns or found.isEmpty():
        return failed("No records found")
    made = records.transform(found, sources.read_config(config, spark) if config else None, enrichers, flatten_depth)
    write, suffix = {"csv": (files.write_csv_file, "csv"), "json": (files.write_json_file, "json"), "excel": (files.write_excel_file, "xlsx")}[output_format]
    at = beside(path, os.path.basename(files.output_name(path, suffix)), output)
    output_file = tried(write, made.frame, at)
    summary = made.summary | {"processing_time_ms": round((time.perf_counter() - began) * 1000, 2)}
    return {"status": "success", "summary": summary, "validation": made.validation, "output_file": output_file}


def process_invoices(spark: SparkSession, path: str, known: DataFrame | None = None, today: str | None = None, output: str | None = None) -> DataFrame:
    """Fields, line items and checks of the invoices at ``path`` (PDF or text files); as JSON too if ``output`` is given."""
    docs = documents.read_pdfs(spark, path) if path.lower().endswith(".pdf") else documents.read_texts(spark, path)
    found = invoices.process(docs, ["doc_id"], F.lit(today).cast("date") if today else None, known)
    if output:
        files.write_invoices(found, output)
    return found
