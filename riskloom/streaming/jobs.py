"""Structured Streaming jobs: ingest, counters, latest status, sliding alerts and deduplication.

Each job runs over the files present (availableNow) and keeps its state and output in the shared
folder, so a restart continues from its last committed batch.
"""

from __future__ import annotations

import datetime
import threading
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from riskloom.session import fresh_path
from riskloom.streaming import stateful


def stream_table(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """File stream over a folder of Parquet files, or over one file.

    The path is given as a pattern: a plain path must be a folder, a pattern may name either.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs to the end of the available files. Batches land in their own folder, replaced on retry."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    job = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    job.awaitTermination()
    return job


def output_of(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """The rows a job wrote, with the id of the batch that wrote them."""
    spark = stream.sparkSession
    base = fresh_path(spark, label)
    run_available(stream, base + "/out", base + "/checkpoint", mode)
    schema = stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).parquet(base + "/out")


def latest_update(rows: DataFrame, *keys: str) -> DataFrame:
    """The state after the last batch, from the rows of an update-mode job."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def latest_status(stream: DataFrame, key: str, ts: str, row_id: str, status: str) -> DataFrame:
    """Latest status per key by event time; ties by row id."""
    return stream.groupBy(key).agg(F.max_by(status, F.struct(ts, row_id)).alias(status), F.count(F.lit(1)).alias("updates"))


def settled_output(spark: SparkSession, path: str, schema: str, build: Callable[[DataFrame], DataFrame], key: str, ts: str,
                   beyond: datetime.timedelta, label: str, mode: str = "append", files_per_batch: int = 64) -> tuple[DataFrame, str]:
    """Rows (with batch_id) of a stateful job over a backlog, and its checkpoint: the files present, then a heartbeat that
    settles what still waits. The job is stopped and started again between the two, from its checkpoint."""
    base = fresh_path(spark, label)
    beats = base + "/beats"
    spark.createDataFrame([], schema).write.parquet(beats)
    rows = stream_table(spark, path, schema, files_per_batch).unionByName(spark.readStream.schema(schema).parquet(beats))
    with stateful.with_state_store(spark):
        run_available(build(rows), base + "/out", base + "/checkpoint", mode)
        stateful.write_heartbeat(spark.read.schema(schema).parquet(path), key, ts, beyond, beats)
        run_available(build(rows), base + "/out", base + "/checkpoint", mode)
    return spark.read.schema(build(rows).schema.add("batch_id", "long")).parquet(base + "/out"), base + "/checkpoint"


class _Progress(StreamingQueryListener):
    """Keeps the observed metrics of every batch of one named stream."""

    def __init__(self, name: str):
        self.name, self.seen, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name and event.progress.observedMetrics:
            self.seen[event.progress.batchId] = event.progress

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def observed_counters(stream: DataFrame, counters: Mapping[str, Column], label: str) -> tuple[DataFrame, DataFrame]:
    """Runs an append job and takes its counters on the way, from the progress of each batch: no pass of their own, no state.

    Returns the job's rows, and (batch_id, the counters, running_ totals of each) with a row a batch.
    """
    spark, base = stream.sparkSession, fresh_path(stream.sparkSession, label)
    name = base.rsplit("/", 1)[-1]
    watch = _Progress(name)
    spark.streams.addListener(watch)
    try:
        def put(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

        seen = stream.observe("counters", *[c.cast("long").alias(n) for n, c in counters.items()])
        job = seen.writeStream.queryName(name).option("checkpointLocation", base + "/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
        job.awaitTermination()
        # The last batches' progress arrives before the end of the stream does.
        watch.ended.wait(60)
    finally:
        spark.streams.removeListener(watch)
    totals, rows = dict.fromkeys(counters, 0), []
    for batch, progress in sorted(watch.seen.items()):
        own = progress.observedMetrics["counters"].asDict()
        totals = {n: totals[n] + (own[n] or 0) for n in counters}
        rows.append((batch, *[own[n] or 0 for n in counters], *totals.values()))
    shape = ", ".join(["batch_id long", *[f"`{n}` long" for n in counters], *[f"`running_{n}` long" for n in counters]])
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(base + "/out"), spark.createDataFrame(rows, shape)


def corrected_alerts(alerts: DataFrame, late: DataFrame, rows: DataFrame, key: str, ts: str, least: int, hours: int = 24) -> DataFrame:
    """Alerts with the windows of late rows counted anew from the table: a late row is settled by a small batch job.

    `rows`: all rows that count. Only rows of the late rows' keys are looked at.
    """
    def ends(us: Column) -> Column:
        hour = F.floor(us / stateful.HOUR)
        return F.explode(F.transform(F.sequence(hour + 1, hour + hours), lambda h: F.timestamp_micros(h * stateful.HOUR)))

    touched = late.select(key, ends(F.col("us")).alias("window_end")).distinct()
    mine = rows.join(late.select(key).distinct(), key, "left_semi").select(key, ends(F.unix_micros(ts)).alias("window_end"))
    counts = mine.join(touched, [key, "window_end"], "left_semi").groupBy(key, "window_end").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return alerts.join(touched, [key, "window_end"], "left_anti").unionByName(counts)


def sliding_alerts(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Of the rows of a `sliding_counts` job: the alerts (key, window_end, n), and the late rows (key, id, us)."""
    alerts = latest_update(rows.where("not is_late").select(F.col("key").alias(key), F.timestamp_micros("us").alias("window_end"), "n", "batch_id"), key, "window_end")
    return alerts, rows.where("is_late").select(F.col("key").alias(key), "id", "us")
