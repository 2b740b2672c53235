"""Keyed streaming operators with their own state, timers and a side output for late rows.

Rows come with their event time as a plain number, so rows behind the watermark reach the operator. It lists them as late
(`is_late`) and leaves its state alone, instead of losing them without a word. State is bounded by the lateness, not by the
backlog: what the watermark has passed is settled by a timer and removed.

State is kept by the RocksDB provider (`with_state_store`). A backlog that ends is closed by a heartbeat: one last file whose
row has neither key nor id, and a time beyond every timer (`write_heartbeat`).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000


@contextmanager
def with_state_store(spark: SparkSession):
    """State of the queries started inside is kept by RocksDB, which state variables need; the session is left as it was."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class _Watermarked(StatefulProcessor):
    def mark(self, timers) -> int:
        """The watermark in microseconds: rows before it are late. Before there is one, no row is."""
        return timers.getCurrentWatermarkInMs() * 1000 or np.iinfo(np.int64).min

    def wake(self, us: int) -> None:
        """A timer once the watermark has passed this time."""
        self.handle.registerTimer(int(us) // 1000 + 1)

    def close(self) -> None:
        pass


class TtlMarks(_Watermarked):
    """Marks the requests that open a window of `ttl` microseconds. Requests wait until the watermark has passed them and are
    then marked in order of time, so files may come in any order within the lateness."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long, id long")
        self.until = handle.getValueState("until", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, first = self.mark(timerValues), None
        for pdf in rows:
            if pd.isna(key[0]):
                continue
            late = pdf["us"].to_numpy() < mark
            if late.any():
                yield _rows(key, pdf["us"][late], pdf["id"][late], None, True)
            kept = pdf[~late]
            if len(kept):
                self.held.appendList(list(zip(kept["us"].tolist(), kept["id"].tolist())))
                first = min(int(kept["us"].min()), first if first is not None else int(kept["us"].min()))
        if first is not None:
            self.wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = self.mark(timerValues)
        held = sorted(self.held.get()) if self.held.exists() else []
        ready = [r for r in held if r[0] < mark]
        rest = held[len(ready):]
        until = self.until.get()[0] if self.until.exists() else None
        flags = []
        for us, _ in ready:
            miss = until is None or us > until
            until = us + self.ttl if miss else until
            flags.append(miss)
        if ready:
            self.held.put(rest) if rest else self.held.clear()
            yield _rows(key, [r[0] for r in ready], [r[1] for r in ready], flags, False)
        if until is None or (not rest and until < mark):
            # No later request can fall into the window: nothing of the key stays.
            self.until.clear()
            if rest:
                self.wake(rest[0][0])
            return
        if ready:
            self.until.update((until,))
        self.wake(rest[0][0] if rest else until)


class SlidingCounts(_Watermarked):
    """Counts of a key in sliding windows of `hours`, by the hour; a key's hours that no open window needs are removed.

    A batch gives the new count of every window it touches that reaches `least`."""

    def __init__(self, hours: int, least: int):
        self.hours, self.least = hours, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getMapState("count", "hour long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, touched = self.mark(timerValues), {}
        for pdf in rows:
            if pd.isna(key[0]):
                continue
            us = pdf["us"].to_numpy()
            late = us < mark
            if late.any():
                yield _counts(key, us[late], np.ones(int(late.sum()), np.int64), pdf["id"][late], True)
            hours, n = np.unique(us[~late] // HOUR, return_counts=True)
            for h, c in zip(hours.tolist(), n.tolist()):
                touched[h] = touched.get(h, 0) + c
        if not touched:
            return
        all_hours = {k[0]: v[0] for k, v in self.count.iterator()}
        for h, c in touched.items():
            all_hours[h] = all_hours.get(h, 0) + c
            self.count.updateValue((h,), (all_hours[h],))
        # The window that ends with hour e holds the hours e - hours + 1 to e.
        ends = sorted({e for h in touched for e in range(h, h + self.hours)})
        sums = [sum(all_hours.get(h, 0) for h in range(e - self.hours + 1, e + 1)) for e in ends]
        hot = [(e, n) for e, n in zip(ends, sums) if n >= self.least]
        if hot:
            yield _counts(key, np.array([(e + 1) * HOUR for e, _ in hot]), np.array([n for _, n in hot]), None, False)
        self.wake((min(touched) + self.hours) * HOUR)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        least = self.mark(timerValues) // HOUR
        hours = sorted(k[0] for k in self.count.keys()) if self.count.exists() else []
        # Rows still to come are of hour `least` or after; their windows reach back hours - 1.
        gone = [h for h in hours if h + self.hours <= least]
        for h in gone:
            self.count.removeKey((h,))
        if len(gone) < len(hours):
            self.wake((hours[len(gone)] + self.hours) * HOUR)
        return iter(())


def _rows(key, us, ids, flags, late: bool) -> pd.DataFrame:
    return pd.DataFrame({"key": key[0], "id": np.asarray(ids, dtype=np.int64), "us": np.asarray(us, dtype=np.int64),
                         "is_miss": pd.array(flags if flags is not None else [None] * len(us), dtype="boolean"), "is_late": late})


def _counts(key, us, n, ids, late: bool) -> pd.DataFrame:
    return pd.DataFrame({"key": key[0], "us": np.asarray(us, dtype=np.int64), "n": np.asarray(n, dtype=np.int64),
                         "id": pd.array(list(ids) if ids is not None else [None] * len(us), dtype="Int64"), "is_late": late})


def _keyed(events: DataFrame, key: str, ts: str, row_id: str, late: str):
    """Grouped rows (key, id, us). The event time is a plain number there: Spark drops no late row before the operator."""
    # Of the rows without a key only heartbeats stay: a filter on all of them would be moved below the watermark.
    marked = events.where(F.col(key).isNotNull() | F.col(row_id).isNull()).withWatermark(ts, late)
    return marked.select(F.col(key).alias("key"), F.col(row_id).alias("id"), F.unix_micros(ts).alias("us")).groupBy("key")


def ttl_marks(events: DataFrame, key: str, ts: str, row_id: str, seconds: int = 300, late: str = "1 hour") -> DataFrame:
    """(key, id, us, is_miss, is_late): each request once, when the watermark has passed it.

    A late row (further behind the newest row than `late`, when it comes) has is_late and no is_miss. Rows without a key are
    no requests: they only move the watermark.
    """
    kind = events.schema[key].dataType.simpleString()
    return _keyed(events, key, ts, row_id, late).transformWithStateInPandas(
        TtlMarks(seconds * 1_000_000), f"key {kind}, id long, us long, is_miss boolean, is_late boolean", "Append", "EventTime")


def sliding_counts(events: DataFrame, key: str, ts: str, row_id: str, least: int, late: str, hours: int = 24) -> DataFrame:
    """(key, us, n, id, is_late): for an update-mode job. Either the count n of the window that ends at `us`, or a late row at `us`."""
    kind = events.schema[key].dataType.simpleString()
    return _keyed(events, key, ts, row_id, late).transformWithStateInPandas(
        SlidingCounts(hours, least), f"key {kind}, us long, n long, id long, is_late boolean", "Update", "EventTime")


def write_heartbeat(rows: DataFrame, key: str, ts: str, beyond: datetime.timedelta, path: str) -> None:
    """One file with one row of no key, whose time lies `beyond` the newest of `rows`: it settles what a backlog leaves open."""
    newest = rows.agg(F.max(ts)).first()[0]
    if newest is not None:
        last = rows.sparkSession.createDataFrame([(newest + beyond,)], "t timestamp")
        last.select(*[(F.col("t") if c == ts else F.lit(None)).cast(kind).alias(c) for c, kind in rows.dtypes]).coalesce(1).write.mode("append").parquet(path)
