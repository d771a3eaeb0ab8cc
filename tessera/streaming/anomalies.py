"""Anomalies of a stream of log entries: closed windows feed running moments, which give what the batch operator gives.

The state of a key is the count of its windows, the sum and the sum of squares of their errors (integers of any size), and
its records: windows with more errors than all before them. A threshold is first crossed by a record, whatever it is, so
these few rows give the first anomalous window for the mean and deviation of all windows so far, exactly as
``operators.incidents.anomaly`` finds it over a whole table. Records are at most as many as the highest count of errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.incidents import Z_THRESHOLD
from tessera.streaming.incidents import timeline

SUMMARY = "key string, upto string, n long, start string, score double, baseline double, peak long, raised boolean"


def summary(n: int, s: int, q: int, only: str, records: list[tuple[str, int]]) -> tuple[str | None, float, float, int]:
    """start, score, baseline and peak of n windows with these sums; ``only`` is the first window."""
    peak, spread = records[-1][1], n * q - s * s
    if n < 2:
        return only, 0.0, s / n, peak
    high = [b for b, e in records if n * e > s and (n * e - s) ** 2 > int(Z_THRESHOLD**2) * spread]
    return (high[0] if high else None), max(0.0, (n * peak - s) / sqrt(spread)) if spread else 0.0, s / n, peak


class Moments(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, s string, q string, only string, start string")
        self.records = handle.getListState("records", "bucket string, error long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((b, int(e)) for part in rows for b, e in zip(part["bucket"], part["error"], strict=True))
        n, s, q, only, before = self.sums.get() if self.sums.exists() else (0, "0", "0", new[0][0], None)
        s, q, records = int(s), int(q), [(r[0], r[1]) for r in self.records.get()] if n else []
        for bucket, error in new:
            n, s, q = n + 1, s + error, q + error * error
            if not records or error > records[-1][1]:
                records.append((bucket, error))
                self.records.appendValue((bucket, error))
        start, score, baseline, peak = summary(n, s, q, only, records)
        self.sums.update((n, str(s), str(q), only, start))
        yield pd.DataFrame({"key": [key[0]], "upto": [new[-1][0]], "n": [n], "start": [start], "score": [score], "baseline": [baseline], "peak": [peak], "raised": [start is not None and start != before and n > 1]})

    def close(self) -> None:
        pass


def anomalies(entries: DataFrame, late: str = "10 minutes", width: str = "1 minute", by: str | None = None) -> DataFrame:
    """A row with SUMMARY for each key (values of ``by``; else one) whenever windows of it close.

    ``start``, ``score``, ``baseline`` and ``peak`` are those of all windows closed so far; ``raised`` tells that the first
    anomalous window is another than before. Needs a RocksDB state store.
    """
    windows = timeline(entries, late, width, by)
    keyed = windows.select((F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")).alias("key"), "bucket", "error")
    return keyed.groupBy("key").transformWithStateInPandas(Moments(), SUMMARY, "append", "None")
