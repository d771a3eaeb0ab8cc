"""The registry of seen invoices in a stream: state by groups of numbers, an initial state from earlier batches, and forgetting by timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


#: Groups that numbers are dealt to; a group's numbers are read and checked together. It can't change between restarts.
GROUPS = 2048
#: Chunks of a group's state that are left before they are merged, and the share of ``keep`` by which numbers outlive it in the state.
CHUNKS, SLACK = 16, 8


class Registry(StatefulProcessor):
    """Marks all invoices of a number but the first in ``order``; the state of a group of numbers holds those that have come.

    State is a list of chunks: each batch adds one of its new numbers. Of a batch's rows only the earliest so far of each new
    number is held, so a number that very many invoices share needs no memory. Numbers are compared as they are, not by hashes.
    """

    def __init__(self, order: list[str], names: list[str], time: str, keep: timedelta | None):
        self.order, self.names, self.time, self.keep = order, names, time, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "numbers array<string>, untils array<long>, known boolean")

    def marked(self, rows: pd.DataFrame, status: str) -> pd.DataFrame:
        return rows[self.names].assign(duplicate_check=status)

    def stored(self) -> tuple[set[str], dict[str, int], int]:
        """Numbers that stay for ever, when each of the others may be forgotten (in milliseconds; 0 for never), and the chunks."""
        known, others, chunks = set(), {}, 0
        for numbers, untils, of_known in self.seen.get():
            chunks += 1
            if of_known:
                known.update(numbers)
                continue
            for number, until in zip(numbers, untils, strict=True):
                others[number] = max(until, others.get(number, 0))
        return known, others, chunks

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, others, chunks = self.stored()
        live = known | (others.keys() if self.keep is None else self.live(others, timerValues).keys())
        first, come = None, {}
        for part in rows:
            self.note(come, part)
            again = part["invoice_number"].isin(live)
            if again.any():
                yield self.marked(part[again], "warning")
                part = part[~again]
            part = part if first is None else pd.concat([first, part])
            part = part.sort_values(self.order, kind="stable", na_position="first", ignore_index=True)
            repeated = part.duplicated("invoice_number")
            first = part[~repeated]
            if repeated.any():
                yield self.marked(part[repeated], "warning")
        if first is not None and len(first):
            yield self.marked(first, "passed")
        new = {n: until for n, until in come.items() if n not in known and (n not in live or until > others.get(n, 0))}
        self.remember(new, known, others, chunks, timerValues)

    def note(self, come: dict[str, int], part: pd.DataFrame) -> None:
        """When the numbers of some rows may be forgotten."""
        if self.keep is None:
            come.update(dict.fromkeys(part["invoice_number"], 0))
            return
        for number, time in part.groupby("invoice_number")[self.time].max().items():
            until = 0 if pd.isna(time) else int((time + self.keep).timestamp() * 1000)
            come[number] = max(until, come.get(number, 0))

    def live(self, others: dict[str, int], timerValues) -> dict[str, int]:
        now = timerValues.getCurrentWatermarkInMs()
        return {n: until for n, until in others.items() if until > now}

    def remember(self, new: dict[str, int], known: set[str], others: dict[str, int], chunks: int, timerValues) -> None:
        if not new:
            return
        if chunks < CHUNKS:
            self.seen.appendValue((list(new), list(new.values()), False))
        else:
            self.replace(known, (others if self.keep is None else self.live(others, timerValues)) | new)
        if self.keep is not None and not any(True for _ in self.handle.listTimers()):
            self.wake(new)

    def replace(self, known: set[str], others: dict[str, int]) -> None:
        made = [(list(known), [], True)] if known else []
        made += [(list(others), list(others.values()), False)] if others else []
        if made:
            self.seen.put(made)
        else:
            self.seen.clear()

    def wake(self, others: dict[str, int]) -> None:
        """The next time at which the state lets go of numbers; whether one still counts is told by its own time."""
        self.handle.registerTimer(min(others.values()) + int(self.keep.total_seconds() * 1000) // SLACK)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, others, _ = self.stored()
        left = self.live(others, timerValues)
        self.replace(known, left)
        if left:
            self.wake(left)
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.appendValue((initialState["invoice_number"].tolist(), [], True))

    def close(self) -> None:
        pass


def checked_invoices(invoices: DataFrame, order: list[str], known: DataFrame | None = None, time: str = "ts", keep: timedelta | None = None, late: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """``invoices`` (a stream) with duplicate_check, as ``operators.invoices.repeats`` marks a batch.

    Numbers of ``known``, a batch table with invoice_number, are in the registry from the start. A number is remembered for
    ever, or for ``keep`` after its latest invoice by ``time`` (those of ``known`` for ever all the same). Invoices that
    come in one batch of the stream go by ``order``. Those without a number are "skipped" and need no state. Needs a
    RocksDB state store; columns must be of plain types. Numbers are dealt to ``groups`` by their hash; a batch reads the
    state of the groups that its numbers are of, so a larger registry wants more of them.
    """
    schema = T.StructType([*invoices.schema.fields, T.StructField("duplicate_check", T.StringType())])
    named = F.coalesce("invoice_number", F.lit("")) != ""
    watched = invoices if keep is None else invoices.withWatermark(time, late)
    group = F.pmod(F.xxhash64("invoice_number"), F.lit(groups)).alias("__group")
    start = None if known is None else known.select("invoice_number").filter(named).distinct().select(group, "invoice_number").groupBy("__group")
    registry = Registry(order, invoices.columns, time, keep)
    checked = watched.filter(named).select(group, "*").groupBy("__group").transformWithStateInPandas(registry, schema, "append", "None" if keep is None else "EventTime", start)
    return checked.unionByName(watched.filter(~named).withColumn("duplicate_check", F.lit("skipped")))
