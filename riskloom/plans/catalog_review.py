"""Review queue, retraining and retention over queue rows made from documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import retention, review
from riskloom.operators.predicates import update_where_key
from riskloom.plans.registry import query

QUEUE_SQL = """
q0 as (select o_orderkey as item_id, case when o_orderkey % 2 = 0 then 'conversation' else 'post' end as item_type, o_totalprice / 600000 as model_confidence,
  o_orderpriority = '1-URGENT' as is_new_pattern, (o_custkey % 30) / 100.0::double as drift_score, (o_orderkey % 4)::int as n_new_keywords, o_orderdate as created_at,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'in_review' end as review_status, o_custkey % 3 = 0 as used_in_retraining,
  (o_orderkey % 11) / 10.0::double as human_confidence, case o_orderkey % 5 when 0 then 'Scam' when 1 then 'harmful' when 2 then null else 'legitimate' end as human_label from orders),
q as (select *, round(least(case when model_confidence < 0.7 then 0.4::double else 0 end + case when is_new_pattern then 0.3::double else 0 end + drift_score * 0.2::double + n_new_keywords * 0.05::double, 1.0::double), 9) as priority_score from q0)"""


def _queue(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = F.col("o_orderstatus")
    rows = t("orders").select(
        key.alias("item_id"), F.when(key % 2 == 0, "conversation").otherwise("post").alias("item_type"),
        (F.col("o_totalprice") / 600000).alias("model_confidence"), (F.col("o_orderpriority") == "1-URGENT").alias("is_new_pattern"),
        ((cust % 30) / 100.0).alias("drift_score"), (key % 4).cast("int").alias("n_new_keywords"), F.col("o_orderdate").alias("_at"),
        status.alias("_status"), (cust % 3 == 0).alias("_used"), ((key % 11) / 10.0).alias("human_confidence"),
        F.when(key % 5 == 0, "Scam").when(key % 5 == 1, "harmful").when(key % 5 == 2, None).otherwise("legitimate").alias("human_label"))
    queued = review.enqueue(rows, F.col("_at"))
    return queued.withColumns({
        "priority_score": F.round("priority_score", 9),
        "review_status": F.when(F.col("_status") == "F", "completed").when(F.col("_status") == "O", "pending").otherwise("in_review"),
        "used_in_retraining": F.col("_used"),
    }).drop("_at", "_status", "_used")


@query("review_priority", f"with {QUEUE_SQL} select item_id, priority_score, epoch_us(created_at + interval 24 hour) as deadline_us from q")
def _(t):
    return _queue(t).select("item_id", "priority_score", F.unix_micros("review_deadline").alias("deadline_us"))


@query("needs_review", f"""with {QUEUE_SQL}
select item_id, model_confidence < 0.7 or is_new_pattern or drift_score > 0.15 or coalesce(case when item_id % 6 = 0 then 'high_entropy' when item_id % 6 = 1 then 'other' end in ('high_entropy', 'disagreement'), false) as review from q""")
def _(t):
    kind = F.when(F.col("item_id") % 6 == 0, "high_entropy").when(F.col("item_id") % 6 == 1, "other")
    return _queue(t).select("item_id", review.needs_review(
        F.col("model_confidence"), F.col("is_new_pattern"), F.col("drift_score"), kind).alias("review"))


@query("review_batch", f"""with {QUEUE_SQL}
select item_id, priority_score from q where review_status = 'pending' order by priority_score desc, created_at, item_id limit 50""")
def _(t):
    return review.review_batch(_queue(t)).select("item_id", "priority_score")


@query("review_batch_status_move", f"""with {QUEUE_SQL},
b as (select item_id from q where review_status = 'pending' order by priority_score desc, created_at, item_id limit 50)
select item_id, case when item_id in (select item_id from b) then 'in_review' else review_status end as review_status from q""")
def _(t):
    return review.take_batch(_queue(t)).select("item_id", "review_status")


@query("conditional_status_update", """
select o_orderkey, case when o_custkey in (select c_custkey from customer where c_acctbal < 0) then 'X' else o_orderstatus end as o_orderstatus,
  case when o_custkey in (select c_custkey from customer where c_acctbal < 0) then 0 else o_totalprice end as o_totalprice from orders""")
def _(t):
    keys = t("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    out = update_where_key(t("orders"), keys, "o_custkey", {"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)})
    return out.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("mark_used_originals", """
select doc_id, exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1) as used_in_training from documents d""")
def _(t):
    docs = t("documents").select("doc_id", F.lit(False).alias("used_in_training"))
    derived = t("labels").filter("quality = 1").select("doc_id")
    used = docs.select("doc_id").join(derived, "doc_id", "left_semi")
    return update_where_key(docs, used, "doc_id", {"used_in_training": F.lit(True)})


@query("retraining_candidates", f"""with {QUEUE_SQL}
select item_id, drift_score, human_confidence from q where review_status = 'completed' and not used_in_retraining and human_confidence >= 0.7""")
def _(t):
    return review.retraining_candidates(_queue(t)).select("item_id", "drift_score", "human_confidence")


@query("retrain_trigger", f"""with {QUEUE_SQL}, c as (select * from q where review_status = 'completed' and not used_in_retraining and human_confidence >= 0.7)
select count(*) as candidates, count_if(drift_score > 0.15)::bigint as drifted, count(*) >= 100 or count_if(drift_score > 0.15) >= 20 as retrain from c""")
def _(t):
    return review.retrain_trigger(review.retraining_candidates(_queue(t)))


@query("training_texts", f"""with {QUEUE_SQL}, c as (select * from q where review_status = 'completed' and not used_in_retraining and human_confidence >= 0.7),
s as (select conv_id, string_agg(text, ' ' order by turn) as spoken from conversations where role = 'user' group by 1)
select item_id, sha256(case when item_type = 'conversation' then spoken else d.text end) as digest, (lower(coalesce(human_label, 'legitimate')) in ('scam', 'malicious', 'harmful'))::int as label
from c left join s on s.conv_id = item_id left join documents d on d.doc_id = item_id where coalesce(case when item_type = 'conversation' then spoken else d.text end, '') <> ''""")
def _(t):
    rows = review.retraining_candidates(_queue(t)).join(
        t("documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id", "left")
    out = review.training_texts(rows, t("conversations"), "user", ["scam", "malicious", "harmful"])
    return out.select("item_id", F.sha2("text", 256).alias("digest"), "label")


@query("recent_pattern_weights", """
with r as (select o_orderkey as id, o_orderpriority as w, (o_orderkey % 11) / 10.0::double as h from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 400 day
  union all select o_orderkey, 'status ' || o_orderstatus, (o_orderkey % 11) / 10.0::double from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 400 day),
s as (select w, sum(h) as raw from r group by 1)
select w as word, round(raw / (select max(raw) from s), 6) as weight from s""")
def _(t):
    orders = t("orders")
    now = orders.agg(F.max("o_orderdate")).scalar()
    recent = orders.filter(F.col("o_orderdate") >= now - F.expr("interval 400 days")).select(
        F.array(F.struct(F.col("o_orderpriority").alias("keyword"))).alias("keywords"),
        F.array(F.struct(F.concat(F.lit("status "), "o_orderstatus").alias("pattern"))).alias("patterns"),
        ((F.col("o_orderkey") % 11) / 10.0).alias("human_confidence"))
    out = review.pattern_weights(recent, {"keywords": "keyword", "patterns": "pattern"})
    return out.select("word", F.round("weight", 6).alias("weight"))


@query("retention_kept_rows", """
with c as (select max(o_orderdate) as now from orders)
select o_orderkey from orders, c where o_orderdate >= now - interval 300 day or o_orderstatus <> 'F'""")
def _(t):
    orders = t("orders")
    clock = orders.agg(F.max("o_orderdate")).scalar()
    return retention.kept_rows(orders, "o_orderdate", clock, 300, F.col("o_orderstatus") != "F").select("o_orderkey")


@query("retention_deleted_counts", """
with c as (select timestamp '2024-01-25 00:00:00' as now)
select 'events' as table_name, count_if(ts < now - interval 10 day)::bigint as deleted, count_if(ts >= now - interval 10 day)::bigint as kept from events, c
union all select 'errors', count_if(ts < now - interval 10 day and event_type <> 'error')::bigint, count_if(ts >= now - interval 10 day or event_type = 'error')::bigint from events, c
union all select 'orders', count_if(o_orderdate < now - interval 10 day)::bigint, count_if(o_orderdate >= now - interval 10 day)::bigint from orders, c""")
def _(t):
    clock = F.lit("2024-01-25 00:00:00").cast("timestamp")
    events = t("events")
    return retention.deleted_counts({
        "events": (events, "ts", None), "errors": (events, "ts", F.col("event_type") == "error"),
        "orders": (t("orders"), "o_orderdate", None)}, clock, 10)
