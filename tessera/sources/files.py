"""Writers. Frames go out in parallel as directories, or as one file that is joined from what the tasks wrote."""

from __future__ import annotations

import csv
import io
import json
import os
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import iso, quoted
from tessera.operators.incidents import Report
from tessera.operators.quality import Profile
from tessera.sources.paths import joined, remove, write_text

#: A bound on the rows of one file that a caller may set; workbooks, which are built in memory, have one of their own.
MOST_ROWS: int | None = None
MOST_SHEET_ROWS = 1_000_000


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def within_bound(df: DataFrame, most: int | None) -> None:
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; write a directory instead")


def bounded(df: DataFrame) -> list[dict]:
    within_bound(df, MOST_SHEET_ROWS)
    return [r.asDict(recursive=True) for r in df.collect()]


def as_one_file(df: DataFrame, path: str, form: str, options: dict, **around) -> None:
    """Tasks write parts, in the order of the rows; the parts are joined to one file in whatever store it lies."""
    within_bound(df, MOST_ROWS)
    spark, folder = df.sparkSession, f"{path}._parts-{uuid4().hex}"
    try:
        df.write.format(form).options(**options).save(folder)
        joined(spark, folder, path, **around)
    finally:
        remove(spark, folder)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which CSV can hold."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    return df.select(*[F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, nested) else quoted(f.name) for f in df.schema])


def write_csv_file(df: DataFrame, path: str, mark: bool = True) -> None:
    """One CSV file, with a byte order mark by default; of any size."""
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerow(df.columns)
    head = ("\ufeff" if mark else "") + text.getvalue()
    as_one_file(flat(df), path, "csv", {"header": "false", "quote": '"', "escape": '"', "emptyValue": ""}, before=head.encode())


def write_json_file(df: DataFrame, path: str) -> None:
    """One JSON array with an indent of two, of any size; missing values are null."""
    whole = F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"pretty": "true", "ignoreNullFields": "false"})
    rows = df.select(F.concat(F.lit("  "), F.regexp_replace(whole, "\n", "\n  ")).alias("value"))
    empty = df.isEmpty()
    as_one_file(rows, path, "text", {"lineSep": ",\n"}, before=b"[" if empty else b"[\n", behind=b"]" if empty else b"\n]", cut=2)


def write_excel_file(df: DataFrame, path: str, sheet: str = "Transformed Data") -> None:
    """One sheet whose columns are as wide as the header and the first hundred values, 50 at most; needs openpyxl."""
    try:
        import openpyxl
        from openpyxl.utils import get_column_letter
    except ImportError as e:
        raise RuntimeError("Excel files need openpyxl") from e
    rows, book = bounded(df), openpyxl.Workbook()
    page = book.active
    page.title = sheet
    page.append(df.columns)
    for r in rows:
        page.append([r[c] for c in df.columns])
    for i, c in enumerate(df.columns, 1):
        page.column_dimensions[get_column_letter(i)].width = min(max([len(c), *(len(str(r[c])) for r in rows[:100])]) + 2, 50)
    book.save(path)


def write_invoice_excel_file(fields: DataFrame, items: DataFrame, path: str) -> None:
    """One invoice as two sheets, of its fields and of its line items; needs openpyxl."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("Excel files need openpyxl") from e
    book = openpyxl.Workbook()
    book.remove(book.active)
    for title, df in (("Invoice Summary", fields), ("Line Items", items)):
        page = book.create_sheet(title)
        page.append(df.columns)
        for r in bounded(df):
            page.append(list(r.values()))
    book.save(path)


def write_error_summary(patterns: DataFrame, path: str) -> None:
    """All patterns, the commonest first; services joined by semicolons."""
    times = {"first_seen": iso(F.col("first_seen")), "last_seen": iso(F.col("last_seen")), "affected_services": F.array_join("services", ";")}
    rows = patterns.withColumns(times).orderBy(F.desc("n"), "first_place")
    write_csv(rows.select(F.col("pattern").alias("error_pattern"), F.col("n").alias("count"), "first_seen", "last_seen", "affected_services"), path)


def write_timeline(buckets: DataFrame, path: str) -> None:
    names = {"bucket": "timestamp_bucket", "total": "total_count", "error": "error_count", "warning": "warning_count", "info": "info_count"}
    write_csv(buckets.orderBy("bucket").select(*[F.col(c).alias(n) for c, n in names.items()]), path)


def write_report(report: Report, output_files: dict, path: str) -> None:
    write_text(report.entries.sparkSession, path, json.dumps(report.document(output_files), indent=2, ensure_ascii=False, default=str))


def write_profile(spark: SparkSession, found: Profile, cleaned_file: str | None, path: str) -> None:
    write_text(spark, path, json.dumps(found.document(cleaned_file), indent=2, ensure_ascii=False, default=str))


def write_invoices(invoices: DataFrame, path: str) -> None:
    """JSON by invoice number, with signs that file names don't take replaced."""
    safe = F.regexp_replace(F.coalesce("invoice_number", F.lit("unknown")), r"[^\w\-]", "_")
    invoices.withColumn("file", F.concat(F.lit("invoice_"), safe)).write.mode("overwrite").partitionBy("file").json(path)


def output_name(path: str, suffix: str) -> str:
    """The name of an output beside its input."""
    folder, name = os.path.split(path)
    return os.path.join(folder, f"{Path(name).stem.replace('_raw', '')}_transformed.{suffix.lstrip('.')}")


def profile_name(path: str) -> str:
    return f"{os.path.splitext(path)[0]}_profile.json"


def cleaned_name(path: str) -> str:
    return f"{os.path.splitext(path)[0]}_cleaned.csv"
