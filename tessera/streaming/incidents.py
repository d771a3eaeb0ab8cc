"""Streams of log entries: the timeline by windows with a watermark, first occurrences, and repeated invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import minute, pattern_of
from tessera.operators.incidents import is_error


def timeline(entries: DataFrame, late: str = "10 minutes", width: str = "1 minute", by: str | None = None) -> DataFrame:
    """bucket and counts like the batch timeline, for each value of ``by`` if given; a window closes ``late`` after its end."""
    info = F.col("severity").isin("INFO", "DEBUG")
    counts = [F.count("*").alias("total"), F.count_if(is_error()).alias("error"), F.count_if(F.col("severity") == "WARNING").alias("warning"), F.count_if(info).alias("info")]
    own = [by] if by else []
    windows = entries.withWatermark("ts", late).groupBy(F.window("ts", width), *own).agg(*counts)
    return windows.select(minute(F.col("window.start")).alias("bucket"), *own, "total", "error", "warning", "info")


def first_occurrences(entries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Error entries whose pattern has not come within ``late``; state is kept no longer."""
    errors = entries.filter(is_error()).withColumn("pattern", pattern_of(F.col("message")))
    return errors.withWatermark("ts", late).dropDuplicatesWithinWatermark(["pattern"])


def new_invoices(invoices: DataFrame, time: str = "ts", late: str = "30 days") -> DataFrame:
    """Invoices whose number has not come within ``late``."""
    return invoices.withWatermark(time, late).dropDuplicatesWithinWatermark(["invoice_number"])
