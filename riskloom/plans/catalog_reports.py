"""Relational reports: counts, shares, crosstabs, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import ordered, reports
from riskloom.plans.registry import query

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("group_count_desc", "select source, count(*) as n from documents group by source")
def _(t):
    return reports.group_count(t("documents"), "source").orderBy(F.desc("n"), "source")


@query("global_average_or_zero", """
select round(coalesce(avg(case when event_type='purchase' then value end), 0), 6) as avg_value,
       round(coalesce(avg(case when event_type='refund' then value end), 0), 6) as avg_missing from events""")
def _(t):
    def mean(kind):
        return F.round(F.coalesce(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0)), 6)
    return t("events").agg(mean("purchase").alias("avg_value"), mean("refund").alias("avg_missing"))


@query("daily_dashboard_summary", """
select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n,
       round(avg(value), 8) as avg_value from events group by 1, 2""")
def _(t):
    return t("events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 8).alias("avg_value"))


@query("detection_overview_by_day", """
select cast(cast(o_orderdate as date) as varchar) as day, o_orderstatus, count(*) as n,
       round(avg(o_totalprice), 6) as avg_price from orders group by 1, 2""")
def _(t):
    return t("orders").groupBy(F.to_date("o_orderdate").cast("string").alias("day"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("avg_price"))


@query("metrics_view_with_active_users", """
with u as (select event_type, count(distinct user_id) as active_users from events group by 1)
select cast(cast(ts as date) as varchar) as day, e.event_type, cast(json_extract(props, '$.k') as int) >= 50 as flagged,
       count(*) as n, round(avg(value), 8) as avg_value, any_value(active_users) as active_users
from events e join u using (event_type) group by 1, 2, 3""")
def _(t):
    events = t("events")
    users = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("active_users"))
    grouped = events.groupBy(
        F.to_date("ts").cast("string").alias("day"), "event_type",
        (F.get_json_object("props", "$.k").cast("int") >= 50).alias("flagged"),
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 8).alias("avg_value"))
    return grouped.join(users, "event_type", "left")


@query("active_users_beside_groups", """
select lang, source, count(*) as n,
       (select count(distinct d2.n_chars) from documents d2 where d2.lang = d.lang) as distinct_sizes
from documents d group by lang, source""")
def _(t):
    docs = t("documents")
    sizes = docs.groupBy("lang").agg(F.count_distinct("n_chars").alias("distinct_sizes"))
    return reports.group_count(docs, "lang", "source").join(sizes, "lang", "left")


@query("overview_row", """
select count(*) as total, sum(case when lang='en' then 1 else 0 end)::bigint as n_en,
       sum(case when lang='de' then 1 else 0 end)::bigint as n_de, count(distinct source) as n_sources,
       count(distinct text) as n_texts, round(avg(n_chars), 6) as avg_chars from documents""")
def _(t):
    return t("documents").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("lang") == "en").alias("n_en"),
        F.count_if(F.col("lang") == "de").alias("n_de"), F.count_distinct("source").alias("n_sources"),
        F.count_distinct(F.sha2("text", 256)).alias("n_texts"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


@query("value_counts_with_share", """
select lang, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as pct
from documents group by lang""")
def _(t):
    return reports.with_share(reports.group_count(t("documents"), "lang"))


@query("share_of_total_per_kind", """
select event_type, n, round(100.0::double * n / sum(n) over (), 6) as pct
from (select event_type, count(*) as n from events group by 1)""")
def _(t):
    return reports.with_share(reports.group_count(t("events"), "event_type"))


@query("crosstab_zero_filled", """
select o_orderpriority, count_if(o_orderstatus='F')::bigint as "status_F", count_if(o_orderstatus='O')::bigint as "status_O",
       count_if(o_orderstatus='P')::bigint as "status_P", count_if(o_orderstatus='X')::bigint as "status_X"
from orders group by 1""")
def _(t):
    return reports.crosstab(t("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P", "X"], "status_")


@query("indicator_prevalence", """
select lang, round(avg(case when regexp_matches(text, '[0-9]') then 1.0::double else 0.0::double end)*100, 6) as has_digit_pct,
       round(avg(case when contains(text, '@') then 1.0::double else 0.0::double end)*100, 6) as has_at_pct,
       round(avg(case when n_chars > 2000 then 1.0::double else 0.0::double end)*100, 6) as is_long_pct
from documents group by lang""")
def _(t):
    flags = t("documents").select(
        "lang", F.col("text").rlike("[0-9]").alias("has_digit"), F.col("text").contains("@").alias("has_at"),
        (F.col("n_chars") > 2000).alias("is_long"))
    return reports.prevalence(flags, "lang", ["has_digit", "has_at", "is_long"])


@query("histogram_20_bins", """
with s as (select min(value) as lo, max(value) as hi from events),
h as (select least(cast(floor((value - lo) / (hi - lo) * 20) as int), 19) as bin, count(*) as n
      from events, s group by 1)
select r.bin::int as bin, coalesce(h.n, 0) as n from range(20) r(bin) left join h on h.bin = r.bin""")
def _(t):
    return reports.histogram(t("events"), "value", 20)


@query("median_and_box_statistics", """
with q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
                  quantile_cont(value, 0.75) as q3 from events group by 1)
select q.event_type, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
       min(value) filter (value >= q1 - 1.5::double*(q3-q1)) as whisker_low,
       max(value) filter (value <= q3 + 1.5::double*(q3-q1)) as whisker_high
from events e join q using (event_type) group by 1, 2, 3, 4""")
def _(t):
    box = reports.box_statistics(t("events"), "event_type", "value")
    return box.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")],
                      "whisker_low", "whisker_high").orderBy("median", "event_type")


@query("mean_std_min_max", """
select c_mktsegment, round(avg(c_acctbal), 6) as mean, round(stddev_samp(c_acctbal), 6) as std,
       min(c_acctbal) as lo, max(c_acctbal) as hi, count(*) as n from customer group by 1""")
def _(t):
    x = F.col("c_acctbal")
    return t("customer").groupBy("c_mktsegment").agg(
        F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"),
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("n"))


@query("corpus_length_statistics", """
select lang, count(*) as n, round(avg(length(text)), 6) as avg_length, min(length(text)) as min_length,
       max(length(text)) as max_length from documents group by lang""")
def _(t):
    return reports.length_profile(t("documents"), "text", "lang")


@query("dataset_report", """
select 'label' as dimension, coalesce(cast(toxic as varchar), 'none') as value, count(*) as n
  from documents left join labels using (doc_id) group by 2
union all select 'variant', lang, count(*) from documents group by 2
union all select 'source', source, count(*) from documents group by 2
union all select 'size_band', cast(case when n_chars < 1000 then 0 when n_chars < 5000 then 1 else 2 end as varchar), count(*)
  from documents group by 2""")
def _(t):
    rows = t("documents").drop("text").join(t("labels"), "doc_id", "left")
    band = F.when(F.col("n_chars") < 1000, 0).when(F.col("n_chars") < 5000, 1).otherwise(2)
    return reports.distributions(rows, {
        "label": F.coalesce(F.col("toxic").cast("string"), F.lit("none")),
        "variant": "lang", "source": "source", "size_band": band})


@query("request_status_statistics", """
select 'total' as section, 'all' as key, count(*)::double as value from orders
union all select 'status', o_orderstatus, count(*)::double from orders group by 2
union all select 'platform', o_orderpriority, count(*)::double from orders group by 2
union all select 'mean_price', 'completed', round(avg(o_totalprice) filter (o_orderstatus='F'), 6) from orders""")
def _(t):
    orders = t("orders").select(
        "o_totalprice", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("platform"))
    counts = reports.distributions(orders, {"total": F.lit("all"), "status": "status", "platform": "platform"})
    mean = orders.filter("status = 'F'").agg(F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)), 6).alias("value"))
    return counts.select(F.col("dimension").alias("section"), F.col("value").alias("key"),
                         F.col("n").cast("double").alias("value")).unionByName(
        mean.select(F.lit("mean_price").alias("section"), F.lit("completed").alias("key"), "value"))


@query("running_verdict_rate", """
select count(*) as total_scans, count_if(o_orderstatus='F')::bigint as scam_detected,
       count_if(o_orderstatus='P')::bigint as suspicious, count_if(o_orderstatus not in ('F','P'))::bigint as safe,
       round(case when count(*) > 0 then count_if(o_orderstatus='F')::double/count(*) else 0 end, 6) as scam_rate from orders""")
def _(t):
    s = F.col("o_orderstatus")
    return t("orders").agg(
        F.count(F.lit(1)).alias("total_scans"), F.count_if(s == "F").alias("scam_detected"),
        F.count_if(s == "P").alias("suspicious"), F.count_if(~s.isin("F", "P")).alias("safe"),
        F.round(reports.ratio(F.count_if(s == "F"), F.count(F.lit(1))), 6).alias("scam_rate"))


@query("frame_rollup", """
with f as (select user_id, value / 100.0::double as score, cast(json_extract(props, '$.k') as int) as k from events)
select user_id, count(*) as frames, round(avg(score), 6) as mean_score, count_if(score > 0.5)::bigint as flagged,
  round(least(avg(score) + least(count_if(k = 7) * 0.15::double, 0.4::double)
     + least(least(count_if(k = 11) * 0.12::double + count_if(k = 13) * 0.08::double, 0.75::double), 0.5::double), 1.0::double), 6) as confidence,
  (count_if(score > 0.5)::double / count(*) > 0.3 or least(count_if(k = 7) * 0.15::double, 0.4::double) > 0
     or least(least(count_if(k = 11) * 0.12::double + count_if(k = 13) * 0.08::double, 0.75::double), 0.5::double) > 0.1) as is_flagged
from f group by user_id""")
def _(t):
    from riskloom.operators.evidence import frame_rollup
    k = F.get_json_object("props", "$.k").cast("int")
    frames = t("events").select(
        "user_id", (F.col("value") / 100.0).alias("score"), (k == 7).cast("int").alias("bad_codes"),
        (k == 11).cast("int").alias("intent_hits"), (k == 13).cast("int").alias("keyword_hits"))
    out = frame_rollup(frames, "user_id")
    return out.select("user_id", "frames", F.round("mean_score", 6).alias("mean_score"), "flagged",
                      F.round("confidence", 6).alias("confidence"), "is_flagged")


# ---- rows in order -------------------------------------------------------------------------

@query("latest_record_per_key", """
select user_id, event_id, event_type, value from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1""")
def _(t):
    rows = t("events").select("user_id", "event_id", "ts", "event_type", "value")
    return ordered.latest_per_key(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("keep_first_text", """
select doc_id, source from (select doc_id, source, row_number() over (
  partition by text order by (case when source = 'src3' then 0 else 1 end), doc_id) rn from documents) where rn = 1""")
def _(t):
    rows = t("documents").select(
        "doc_id", "source", "text", F.when(F.col("source") == "src3", 0).otherwise(1).alias("place"))
    digest = rows.withColumn("text", F.sha2("text", 256))
    return ordered.keep_first(digest, F.col("text"), ["place", "doc_id"]).select("doc_id", "source")


@query("role_alternation_check", """
with r as (select conv_id, role, row_number() over (partition by conv_id order by turn) rn from conversations)
select conv_id, bool_and(role = case when rn % 2 = 1 then 'user' else 'assistant' end) as alternates, count(*) as turns
from r group by conv_id""")
def _(t):
    placed = ordered.with_position(
        t("conversations").select("conv_id", "turn", "role"), ["conv_id"],
        F.floor(F.col("turn") / 512), [F.col("turn")])
    expected = F.when(F.col("position") % 2 == 1, "user").otherwise("assistant")
    return placed.groupBy("conv_id").agg(
        F.bool_and(F.col("role") == expected).alias("alternates"), F.count(F.lit(1)).alias("turns"))


@query("speaker_turns_joined", """
select conv_id, string_agg(text, ' ' order by turn) as text, count(*) as pieces
from conversations where role = 'user' group by conv_id""")
def _(t):
    return ordered.joined_in_order(
        t("conversations").filter("role = 'user'"), ["conv_id"], "turn", "text")


@query("every_third_event", """
select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i
  from events) where i % 3 = 0""")
def _(t):
    placed = ordered.with_position(
        t("events").select("user_id", "event_id", "ts"), ["user_id"], F.to_date("ts"),
        [F.col("ts"), F.col("event_id")])
    return placed.filter((F.col("position") - 1) % 3 == 0).select("user_id", "event_id")


@query("recent_ring_with_running_totals", """
with r as (select user_id, event_id, event_type,
   row_number() over (partition by user_id order by ts desc, event_id desc) rn,
   count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as total,
   sum(case when event_type='error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as flagged
   from events)
select user_id, event_id, event_type, rn::int as rank, total, flagged from r where rn <= 20""")
def _(t):
    rows = t("events").select("user_id", "event_id", "ts", "event_type").withColumn("flagged", (F.col("event_type") == "error").cast("long"))
    rows = rows.withColumn("total", F.lit(1).cast("long"))
    return ordered.recent_with_totals(rows, "user_id", [F.desc("ts"), F.desc("event_id")], 20, ["total", "flagged"]).drop("ts")


# ---- top-k -----------------------------------------------------------------------------------

@query("key_newest_first", """
select event_id, user_id, epoch_us(ts) as ts_us, value from events where event_type = 'error'
order by ts desc, event_id limit 100""")
def _(t):
    return (t("events").filter("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(100)
            .select("event_id", "user_id", F.unix_micros("ts").alias("ts_us"), "value"))


@query("request_list_with_totals", """
with f as (select * from orders where o_orderstatus = 'P')
select o_orderkey, round(o_totalprice, 6) as price, (select count(*) from orders) as total, (select count(*) from f) as filtered
from f order by o_orderdate desc, o_orderkey limit 50""")
def _(t):
    orders = t("orders")
    wanted = orders.filter("o_orderstatus = 'P'")
    page = wanted.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return page.select(
        "o_orderkey", F.round("o_totalprice", 6).alias("price"),
        orders.agg(F.count(F.lit(1))).scalar().alias("total"),
        wanted.agg(F.count(F.lit(1))).scalar().alias("filtered"))


@query("top_terms", """
select w as term, count(*) as n from (
  select unnest(regexp_extract_all(lower(text), '[a-zA-ZÀ-ỹ]{2,}')) as w from documents)
where w not in ('the', 'and', 'der', 'die', 'que', 'les', 'of', 'to') group by 1 order by n desc, term limit 25""")
def _(t):
    from riskloom.functions.text import word_tokens
    stop = ["the", "and", "der", "die", "que", "les", "of", "to"]
    terms = t("documents").select(F.explode(word_tokens(F.lower("text"))).alias("term"))
    return (reports.group_count(terms.filter(~F.col("term").isin(stop)), "term")
            .orderBy(F.desc("n"), "term").limit(25))


# ---- set operations --------------------------------------------------------------------------

@query("union_with_lineage", """
select split, count(*) as n, count(distinct text) as n_texts, count(role) as n_roles from (
  select 'docs' as split, text, null as role from documents
  union all select 'turns', text, role from conversations
  union all select 'known', text, null from benchmark) group by split""")
def _(t):
    both = (
        t("documents").select("text", F.lit("docs").alias("split"))
        .unionByName(t("conversations").select("text", "role", F.lit("turns").alias("split")), allowMissingColumns=True)
        .unionByName(t("benchmark").select("text", F.lit("known").alias("split")), allowMissingColumns=True))
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2("text", 256)).alias("n_texts"),
        F.count("role").alias("n_roles"))


@query("distinct_on_column", """
select source, min(doc_id) as doc_id from documents group by source""")
def _(t):
    return t("documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("keyword_set_accumulation", """
select distinct w as keyword from (
  select unnest(list_filter(['worthless','pathetic','stupid','idiot','token','license'], lambda k: contains(lower(text), k))) as w from documents
  union all select unnest(list_filter(['loser','hate','orange'], lambda k: contains(lower(text), k))) from conversations)""")
def _(t):
    from riskloom.functions.patterns import matched_words
    known = t("documents").select(F.explode(matched_words(
        F.lower("text"), ["worthless", "pathetic", "stupid", "idiot", "token", "license"])).alias("keyword"))
    found = t("conversations").select(F.explode(matched_words(
        F.lower("text"), ["loser", "hate", "orange"])).alias("keyword"))
    return known.union(found).distinct()


@query("token_set_intersection", """
select doc_id, list_has_any(regexp_split_to_array(lower(text), '[^a-z]+'), ['worthless','pathetic','token','license']) as overlaps from documents""")
def _(t):
    from riskloom.functions.patterns import tokens_overlap
    return t("documents").select("doc_id", tokens_overlap(
        F.lower("text"), ["worthless", "pathetic", "token", "license"]).alias("overlaps"))


@query("map_merge_right_wins", """
select user_id, string_agg(event_type || '=' || c, ',' order by event_type) as merged from (
  select user_id, event_type, case when event_type in ('error', 'view') then -n else n end as c
  from (select user_id, event_type, count(*) as n from events group by 1, 2)) group by user_id""")
def _(t):
    from riskloom.functions.maps import merge_maps
    counts = reports.group_count(t("events"), "user_id", "event_type")
    entry = F.collect_list(F.struct("event_type", "n"))
    late = F.collect_list(F.when(F.col("event_type").isin("error", "view"), F.struct("event_type", -F.col("n"))))
    merged = counts.groupBy("user_id").agg(
        merge_maps(F.map_from_entries(entry), F.map_from_entries(late)).alias("m"))
    pairs = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return merged.select("user_id", F.array_join(pairs, ",").alias("merged"))


@query("merged_corpora", """
with a as (select 'docs' as origin, doc_id as id, text, case when toxic = 1 then 'FAKE_SCAM' when quality = 1 then 'SAFE' else 'OTHER' end as label
           from documents join labels using (doc_id)),
b as (select 'pairs', conv_id, max(case when turn = 0 then text end) || ' [SEP] ' || max(case when turn = 1 then text end),
             case when count(*) >= 4 then 'SAFE' else 'SUSPICIOUS' end from conversations group by conv_id)
select origin, id, label, sha256(text) as digest from (select * from a union all select * from b)
where label in ('SAFE', 'SUSPICIOUS', 'FAKE_SCAM') and text is not null""")
def _(t):
    from riskloom.operators.ordered import hash_order
    label = F.when(F.col("toxic") == 1, "FAKE_SCAM").when(F.col("quality") == 1, "SAFE").otherwise("OTHER")
    docs = t("documents").join(t("labels"), "doc_id").select(
        F.lit("docs").alias("origin"), F.col("doc_id").alias("id"), "text", label.alias("label"))

    def turn(i):
        return F.max(F.when(F.col("turn") == i, F.col("text")))

    pairs = t("conversations").groupBy(F.col("conv_id").alias("id")).agg(
        F.concat(turn(0), F.lit(" [SEP] "), turn(1)).alias("text"),
        F.when(F.count(F.lit(1)) >= 4, "SAFE").otherwise("SUSPICIOUS").alias("label"),
    ).withColumn("origin", F.lit("pairs"))
    both = docs.unionByName(pairs).filter(F.col("label").isin("SAFE", "SUSPICIOUS", "FAKE_SCAM") & F.col("text").isNotNull())
    return (both.select("origin", "id", "label", F.sha2("text", 256).alias("digest"))
            .orderBy(hash_order(F.col("origin"), F.col("id"))))
