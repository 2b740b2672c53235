"""Time-to-live deduplication: the first request of a key opens a window; later ones inside it are hits.

The window is not extended by hits, so each key is a chain of starts. To keep hot keys parallel, a
key's time line is cut into chunks. Each chunk first reports where its chain ends for every way the
chain may come in; those short reports are folded per key; then all chunks mark their starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FREE = np.iinfo(np.int64).min  # no window open


def _over_sorted_groups(df: DataFrame, keys: list[str], order: list[str], per_group, schema: T.StructType) -> DataFrame:
    """Runs `per_group` on each key's rows in order. Keys are dealt to tasks by hash and streamed
    sorted, so thousands of short groups cost one pass and not one Python call frame each."""
    names = schema.names

    def flush(pieces: list[pd.DataFrame], out: dict[str, list]) -> None:
        rows = pieces[0] if len(pieces) == 1 else pd.concat(pieces)
        result = per_group(rows)
        n = len(result[names[-1]])
        for name in names:
            value = rows[name].iloc[0] if name in keys and name not in result else result[name]
            out[name].append(value if np.ndim(value) else np.repeat(np.asarray([value]), n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            out: dict[str, list] = {n: [] for n in names}
            change = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                v = pdf[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(change), len(pdf)]
            if held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
                flush(held, out)
                held = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                held.append(pdf.iloc[a:b])
                if b < len(pdf):
                    flush(held, out)
                    held = []
            if out[names[0]]:
                yield pd.DataFrame({n: np.concatenate(v) for n, v in out.items()})
        if held:
            out = {n: [] for n in names}
            flush(held, out)
            yield pd.DataFrame({n: np.concatenate(v) for n, v in out.items()})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _transfer(ttl: int):
    def report(rows: pd.DataFrame) -> dict:
        t = rows["us"].to_numpy(np.int64)
        nxt = np.searchsorted(t, t + ttl, side="right")
        leave = t + ttl
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                leave[i] = leave[nxt[i]]
        last_of_run = np.append(leave[1:] != leave[:-1], True)
        return {"below": t[last_of_run], "leave": leave[last_of_run]}

    return report


def _fold(rows: pd.DataFrame) -> dict:
    """Walks a key's chunk reports in time order: the end of the window each chunk starts with."""
    chunk, below, leave = (rows[c].to_numpy(np.int64) for c in ("chunk", "below", "leave"))
    heads = np.append(0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1)
    ends = np.append(heads[1:], len(chunk))
    busy, entry = FREE, []
    for a, b in zip(heads, ends):
        entry.append(busy)
        at = a + int(np.searchsorted(below[a:b], busy, side="right"))
        if at < b:
            busy = int(leave[at])
    return {"chunk": chunk[heads], "busy": np.array(entry, dtype=np.int64)}


def _mark(ttl: int):
    def starts(rows: pd.DataFrame) -> dict:
        t, busy, found = rows["us"].to_numpy(np.int64), int(rows["busy"].iloc[0]), []
        i = int(np.searchsorted(t, busy, side="right"))
        while i < len(t):
            found.append(int(t[i]))
            i = int(np.searchsorted(t, found[-1] + ttl, side="right"))
        return {"us": np.array(found, dtype=np.int64)}

    return starts


def ttl_dedup(df: DataFrame, key: str, ts: str, row_id: str, seconds: int = 300, chunk_seconds: int = 86_400) -> DataFrame:
    """Adds `is_miss`: true for the request that opens a window, false for hits."""
    ttl = seconds * 1_000_000
    k = T.StructField("k", df.schema[key].dataType)

    def shape(*names: str) -> T.StructType:
        return T.StructType([k, *[T.StructField(n, T.LongType()) for n in names]])

    us = F.unix_micros(ts)
    times = df.select(F.col(key).alias("k"), us.alias("us")).distinct().withColumn(
        "chunk", F.floor(F.col("us") / (chunk_seconds * 1_000_000)).cast("long"))
    reports = _over_sorted_groups(times, ["k", "chunk"], ["us"], _transfer(ttl), shape("chunk", "below", "leave"))
    entries = _over_sorted_groups(reports, ["k"], ["chunk", "below"], _fold, shape("chunk", "busy"))
    starts = _over_sorted_groups(
        times.join(entries, ["k", "chunk"]), ["k", "chunk"], ["us"], _mark(ttl), shape("us"))
    marked = starts.select(F.col("k").alias(key), F.col("us").alias("_us"), F.lit(True).alias("_start"))
    # Of several requests at one instant the one with the smallest id opens the window.
    first = df.groupBy(F.col(key), us.alias("_us")).agg(F.min(row_id).alias("_first"))
    opened = first.join(marked, [key, "_us"]).select(key, F.col("_first").alias(row_id), F.lit(True).alias("_miss"))
    return df.join(opened, [key, row_id], "left").select(*df.columns, F.coalesce("_miss", F.lit(False)).alias("is_miss"))


def hit_statistics(marked: DataFrame) -> DataFrame:
    """Hits, misses and the hit rate."""
    hits, n = F.count_if(~F.col("is_miss")), F.count(F.lit(1))
    return marked.agg(
        hits.alias("hits"), F.count_if(F.col("is_miss")).alias("misses"),
        F.coalesce(F.try_divide(hits, n), F.lit(0.0)).alias("hit_rate"))
