"""Streaming jobs and their batch twins."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from riskloom.operators import ttl
from riskloom.operators.ingest import post_metadata, quarantine
from riskloom.plans import fixture as fx
from riskloom.plans.registry import query
from riskloom.sources.tables import SCHEMAS
from riskloom.streaming import jobs, stateful

LOW = "lower(text)"
HARM = ["worthless.*the", "token"]


def _stream(t, name):
    return jobs.stream_table(t.spark, t.path(name), SCHEMAS[name])


@query("stream_scan_in_batches", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def _(t):
    rows = jobs.output_of(_stream(t, "events").select("event_id", "event_type", "value"), "scan")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_ingest", f"""
with k as (select doc_id, text, {fx.sql_words(LOW, fx.KEYWORDS)} as keywords from documents where not regexp_matches({LOW}, 'worthless.*the|token'))
select 'meta_' || doc_id as post_id, sha256(text) as content_hash, round(least(case when keywords = '' then 0 else len(string_split(keywords, ',')) end * 0.1::double, 1.0::double), 6) as scam_probability from k""")
def _(t):
    passed, _ = quarantine(_stream(t, "documents"), "doc_id", "text", HARM)
    clock = F.lit("2024-03-01 00:00:00").cast("timestamp")
    meta = post_metadata(passed, "doc_id", "text", clock, fx.KEYWORDS, fx.SLANG_WORDS, fx.KEYWORD_TYPES)
    rows = jobs.output_of(meta, "ingest")
    return rows.select("post_id", "content_hash", F.round("scam_probability", 6).alias("scam_probability"))


@query("stream_ingest_counters", f"""
select case when regexp_matches({LOW}, 'worthless.*the|token') then 'quarantined' when {fx.sql_count_words(LOW, fx.KEYWORDS)} > 1 then 'flagged' else 'processed' end as outcome, count(*) as n from documents group by 1""")
def _(t):
    from riskloom.functions.patterns import any_pattern, count_words
    low = F.lower("text")
    outcome = F.when(any_pattern(low, HARM), "quarantined").when(count_words(low, fx.KEYWORDS) > 1, "flagged").otherwise("processed")
    counts = jobs.running_counts(_stream(t, "documents").select(outcome.alias("outcome")), "outcome")
    return jobs.latest_update(jobs.output_of(counts, "counters", "update"), "outcome")


@query("stream_verdict_counters", """
select case event_type when 'error' then 'FAKE_SCAM' when 'view' then 'SUSPICIOUS' else 'SAFE' end as label, count(*) as n from events group by 1""")
def _(t):
    label = F.when(F.col("event_type") == "error", "FAKE_SCAM").when(F.col("event_type") == "view", "SUSPICIOUS").otherwise("SAFE")
    counts = jobs.running_counts(_stream(t, "events").select(label.alias("label")), "label")
    return jobs.latest_update(jobs.output_of(counts, "verdicts", "update"), "label")


@query("stream_latest_status", """
select user_id, arg_max(event_type, (ts, event_id)) as status, count(*) as updates from events group by 1""")
def _(t):
    rows = _stream(t, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    latest = jobs.latest_status(rows, "user_id", "ts", "event_id", "status")
    return jobs.latest_update(jobs.output_of(latest, "status", "update"), "user_id")


@query("stream_high_risk_alerts", """
with e as (select user_id, ts from events where event_type = 'error'), w as (select user_id, date_trunc('hour', ts) + interval 1 hour + (h * interval 1 hour) as window_end from e, range(24) r(h))
select user_id, epoch_us(window_end) as window_end_us, count(*) as n from w group by 1, 2 having count(*) >= 3""")
def _(t):
    def build(rows):
        return stateful.sliding_counts(rows.where("event_type = 'error' or user_id is null"), "user_id", "ts", "event_id", 3, "2 days")

    rows, _ = jobs.settled_output(t.spark, t.path("events"), SCHEMAS["events"], build, "user_id", "ts", datetime.timedelta(days=4), "alerts", "update")
    alerts, late = jobs.sliding_alerts(rows, "user_id")
    if not late.isEmpty():
        alerts = jobs.corrected_alerts(alerts, late, t("events").where("event_type = 'error'"), "user_id", "ts", 3)
    return alerts.select("user_id", F.unix_micros("window_end").alias("window_end_us"), "n")


TTL_SQL = """
with recursive o as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from events),
r(user_id, event_id, rn, start_us, miss) as (select user_id, event_id, rn, us, true from o where rn = 1
  union all select o.user_id, o.event_id, o.rn, case when o.us > r.start_us + 43200000000 then o.us else r.start_us end, o.us > r.start_us + 43200000000
  from r join o on o.user_id = r.user_id and o.rn = r.rn + 1)"""


@query("ttl_dedup", TTL_SQL + " select user_id, event_id, miss as is_miss from r")
def _(t):
    rows = t("events").select("user_id", "event_id", "ts")
    return ttl.ttl_dedup(rows, "user_id", "ts", "event_id", 43_200, 5 * 86_400).select("user_id", "event_id", "is_miss")


@query("cache_hit_statistics", TTL_SQL + """
select count_if(not miss)::bigint as hits, count_if(miss)::bigint as misses, round(count_if(not miss)::double / count(*), 6) as hit_rate from r""")
def _(t):
    marked = ttl.ttl_dedup(t("events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 43_200)
    return ttl.hit_statistics(marked).withColumn("hit_rate", F.round("hit_rate", 6))


@query("stream_ttl_dedup", TTL_SQL + " select user_id, event_id, miss as is_miss from r")
def _(t):
    def build(rows):
        return stateful.ttl_marks(rows, "user_id", "ts", "event_id", 43_200, "2 days")

    rows, _ = jobs.settled_output(t.spark, t.path("events"), SCHEMAS["events"], build, "user_id", "ts", datetime.timedelta(days=4), "ttl")
    marks = rows.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "is_miss", "is_late")
    late = marks.where("is_late").select("user_id").distinct()
    if not late.isEmpty():
        # Keys with a late row are settled from the table.
        again = ttl.ttl_dedup(t("events").join(late, "user_id", "left_semi").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 43_200)
        marks = marks.join(late, "user_id", "left_anti").select("user_id", "event_id", "is_miss").unionByName(again.select("user_id", "event_id", "is_miss"))
    return marks.select("user_id", "event_id", "is_miss")


@query("stream_observed_counters", f"""
select count_if(regexp_matches({LOW}, 'worthless.*the|token'))::bigint as quarantined, count_if(not regexp_matches({LOW}, 'worthless.*the|token') and {fx.sql_count_words(LOW, fx.KEYWORDS)} > 1)::bigint as flagged,
  count(*)::bigint as processed, sum(length(text))::bigint as chars from documents""")
def _(t):
    from riskloom.functions.patterns import any_pattern, count_words
    low, harm = F.lower("text"), any_pattern(F.lower("text"), HARM)
    counters = {"quarantined": F.count_if(harm), "flagged": F.count_if(~harm & (count_words(low, fx.KEYWORDS) > 1)),
                "processed": F.count(F.lit(1)), "chars": F.sum(F.length("text"))}
    _, told = jobs.observed_counters(_stream(t, "documents").select("doc_id", "text"), counters, "observed")
    return told.agg(*[F.max(f"running_{n}").alias(n) for n in counters])


@query("retention_partition_drop", """
select cast(cast(ts as date) as varchar) as day, count(*) as n from events where cast(ts as date) >= date '2024-01-15' group by 1""")
def _(t):
    from riskloom.session import fresh_path
    base = fresh_path(t.spark, "retention")
    rows = t("events").select("event_id", F.to_date("ts").alias("date"))
    rows.repartition("date").write.partitionBy("date").parquet(base + "/all")
    # Whole date folders are skipped by partition pruning; the kept ones become the new table.
    kept = t.spark.read.schema("event_id long, date date").parquet(base + "/all").filter("date >= date'2024-01-15'")
    kept.write.partitionBy("date").parquet(base + "/kept")
    return t.spark.read.schema("event_id long, date date").parquet(base + "/kept").groupBy(
        F.col("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
