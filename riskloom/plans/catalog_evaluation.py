"""Labels, predictions, metrics, calibration and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fixed
from riskloom.operators import metrics, ordered
from riskloom.operators.lexicon import every_match, first_match
from riskloom.operators.predicates import canonical_label, label_of_flag
from riskloom.plans import fixture as fx
from riskloom.plans.fixture import dbl, quoted
from riskloom.plans.registry import query

BAD = "worthless|pathetic|stupid|idiot|loser"
ODD = "token|@|license"

JUDGED_SQL = f"""
judged as (select d.doc_id, case when l.toxic = 1 then 'FAKE_SCAM' when l.quality = 0 then 'SUSPICIOUS' else 'SAFE' end as expected,
  case when regexp_matches(lower(d.text), '{BAD}') then 'FAKE_SCAM' when regexp_matches(lower(d.text), '{ODD}') then 'SUSPICIOUS' else 'SAFE' end as predicted,
  case {" ".join(f"when regexp_matches(lower(d.text), {quoted(p)}) then '{n}'" for n, p in fx.DOMAINS)} else 'other' end as domain,
  (n_chars % 101) / 100.0::double as p, toxic::double as y from documents d join labels l using (doc_id))"""


def judged(t):
    """Documents with an expected label, a rule prediction, a domain and a probability."""
    low = F.lower("text")
    return t.wide("documents").join(t("labels"), "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, "FAKE_SCAM").when(F.col("quality") == 0, "SUSPICIOUS").otherwise("SAFE").alias("expected"),
        F.when(low.rlike(BAD), "FAKE_SCAM").when(low.rlike(ODD), "SUSPICIOUS").otherwise("SAFE").alias("predicted"),
        first_match(low, fx.DOMAINS, "other").alias("domain"),
        ((F.col("n_chars") % 101) / 100.0).alias("p"), F.col("toxic").cast("double").alias("y"))


PR_SQL = """
m as (select label, count_if(expected = label and predicted = label)::double as tp, count_if(predicted = label)::double as np,
  count_if(expected = label) as support from judged, (values ('FAKE_SCAM'), ('SUSPICIOUS'), ('SAFE')) v(label) group by label),
pr as (select label, support, case when np > 0 then tp / np else 0 end as precision, case when support > 0 then tp / support else 0 end as recall from m),
f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from pr)"""


@query("label_canonical_from_flag", """
select doc_id, case when toxic = 1 then 'FAKE_SCAM' else 'SAFE' end as label from labels""")
def _(t):
    return t("labels").select("doc_id", label_of_flag(F.col("toxic")).alias("label"))


@query("label_canonical_from_text", """
with v as (select event_id, case event_type when 'click' then ' safe ' when 'view' then 'Fake_Scam' when 'error' then null else event_type end as v from events)
select event_id, case when upper(trim(coalesce(v, ''))) in ('FAKE_SCAM', 'SUSPICIOUS', 'SAFE') then upper(trim(v)) else 'SUSPICIOUS' end as label from v""")
def _(t):
    kind = F.col("event_type")
    raw = F.when(kind == "click", " safe ").when(kind == "view", "Fake_Scam").when(kind == "error", None).otherwise(kind)
    return t("events").select("event_id", canonical_label(raw, fixed.LABELS).alias("label"))


@query("scenario_label_map", """
with m(scenario, label) as (values ('1-URGENT', 'FAKE_SCAM'), ('2-HIGH', 'FAKE_SCAM'), ('3-MEDIUM', 'SUSPICIOUS'), ('5-LOW', 'SAFE'))
select o_orderkey, o_orderpriority, coalesce(m.label, 'SUSPICIOUS') as label from orders left join m on m.scenario = o_orderpriority""")
def _(t):
    from riskloom.sources.reference import lookup_table
    table = lookup_table(t.spark, {"1-URGENT": "FAKE_SCAM", "2-HIGH": "FAKE_SCAM", "3-MEDIUM": "SUSPICIOUS", "5-LOW": "SAFE"},
                         "o_orderpriority", "label")
    return t("orders").select("o_orderkey", "o_orderpriority").join(table, "o_orderpriority", "left").select(
        "o_orderkey", "o_orderpriority", F.coalesce("label", F.lit("SUSPICIOUS")).alias("label"))


@query("human_label_binary", """
select event_type, (lower(upper(event_type)) in ('error', 'purchase', 'signup'))::int as y, count(*) as n from events group by 1, 2""")
def _(t):
    y = F.lower(F.upper("event_type")).isin("error", "purchase", "signup").cast("int")
    return t("events").groupBy("event_type", y.alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("predictions_with_labels", f"with {JUDGED_SQL} select doc_id, expected, predicted, domain from judged")
def _(t):
    return judged(t).select("doc_id", "expected", "predicted", "domain")


@query("confusion_matrix", f"""with {JUDGED_SQL}
select v.expected, count_if(predicted = 'FAKE_SCAM') as "FAKE_SCAM", count_if(predicted = 'SUSPICIOUS') as "SUSPICIOUS", count_if(predicted = 'SAFE') as "SAFE"
from (values ('FAKE_SCAM'), ('SUSPICIOUS'), ('SAFE')) v(expected) left join judged j on j.expected = v.expected group by 1""")
def _(t):
    return metrics.confusion_matrix(judged(t), "expected", "predicted", fixed.LABELS)


@query("class_precision_recall", f"""with {JUDGED_SQL}, {PR_SQL}
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from f""")
def _(t):
    out = metrics.class_metrics(judged(t), "expected", "predicted", fixed.LABELS)
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("accuracy_and_f1", f"""with {JUDGED_SQL}, {PR_SQL}
select (select count(*) from judged) as n, round((select avg((expected = predicted)::int) from judged), 6) as accuracy,
  round(avg(f1) filter (support > 0), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from f""")
def _(t):
    out = metrics.accuracy_summary(judged(t), "expected", "predicted", fixed.LABELS)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query("domain_accuracy_and_misses", f"""with {JUDGED_SQL}
select domain, count(*) as n, round(avg((expected = predicted)::int), 6) as accuracy,
  count_if(expected = 'FAKE_SCAM' and predicted = 'SAFE') as scam_as_safe from judged group by domain""")
def _(t):
    return metrics.accuracy_by_domain(judged(t), "domain", "expected", "predicted").withColumn("accuracy", F.round("accuracy", 6))


@query("domain_coverage_by_label", "with " + JUDGED_SQL + ", c as (select expected, unnest(list_filter([" + ", ".join(
    f"case when regexp_matches(lower(text), {quoted(p)}) then '{n}' end" for n, p in fx.DOMAINS)
    + "], lambda x: x is not null)) as domain from judged join documents using (doc_id)) "
    "select domain, count(*) as total, count_if(expected = 'FAKE_SCAM') as scam, count_if(expected = 'SUSPICIOUS') as suspicious, "
    "count_if(expected = 'SAFE') as safe from c group by domain")
def _(t):
    rows = t.wide("documents").join(t("labels"), "doc_id").select(
        F.when(F.col("toxic") == 1, "FAKE_SCAM").when(F.col("quality") == 0, "SUSPICIOUS").otherwise("SAFE").alias("expected"),
        F.explode(every_match(F.lower("text"), fx.DOMAINS)).alias("domain"))
    e = F.col("expected")
    return rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(e == "FAKE_SCAM").alias("scam"),
        F.count_if(e == "SUSPICIOUS").alias("suspicious"), F.count_if(e == "SAFE").alias("safe"))


@query("first_misclassified", f"""with {JUDGED_SQL}
select doc_id, expected, predicted from judged where expected <> predicted order by doc_id limit 10""")
def _(t):
    return judged(t).filter("expected <> predicted").select("doc_id", "expected", "predicted").orderBy("doc_id").limit(10)


BIN_SQL = "(" + " + ".join(f"(p > {dbl(i * 0.1)})::int" for i in range(10)) + ")"
BINS_SQL = f"""bins as (select {BIN_SQL} as bin, count(*) as n, avg(y) as accuracy, avg(p) as avg_confidence, abs(avg(p) - avg(y)) as gap
  from judged where p <= 1 group by 1 having bin > 0)"""


@query("calibration_bins", f"""with {JUDGED_SQL}, {BINS_SQL}
select bin, n, round(accuracy, 6) as accuracy, round(avg_confidence, 6) as avg_confidence, round(gap, 6) as gap from bins""")
def _(t):
    out = metrics.calibration_bins(judged(t), "y", "p")
    return out.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "avg_confidence", "gap")])


GRADE_SQL = ("case when ece < 0.05 then 'Excellent calibration — confidence scores are trustworthy' when ece < 0.10 then "
             "'Good calibration — minor over/under-confidence' when ece < 0.15 then 'Fair calibration — some overconfidence, use with caution' "
             "when ece < 0.20 then 'Poor calibration — significant overconfidence, needs Platt scaling' else "
             "'Very poor calibration — confidence scores are unreliable, MUST calibrate' end")


@query("calibration_error", f"""with {JUDGED_SQL}, {BINS_SQL},
e as (select sum(n / (select count(*)::double from judged) * gap) as ece, max(gap) as mce, count(*) as bins_used from bins)
select round(ece, 6) as ece, round(mce, 6) as mce, bins_used, {GRADE_SQL} as grade from e""")
def _(t):
    out = metrics.calibration_error(judged(t), "y", "p")
    return out.select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"), "bins_used", "grade")


RECAL_SQL = ("(p * 0.4::double + 0.6::double / (1 + exp(-2.5::double * ln(greatest(p, 1e-10::double) / greatest(1 - p, 1e-10::double)) + 0.3::double)))")


@query("calibration_report", f"""with {JUDGED_SQL}, {BINS_SQL},
j2 as (select y, {RECAL_SQL} as p from judged), b2 as (select {BIN_SQL} as bin, count(*) as n, abs(avg(p) - avg(y)) as gap from j2 where p <= 1 group by 1 having bin > 0),
e1 as (select sum(n / (select count(*)::double from judged) * gap) as ece from bins), e2 as (select sum(n / (select count(*)::double from judged) * gap) as ece from b2),
g1 as (select ece, {GRADE_SQL} as g from e1), g2 as (select ece, {GRADE_SQL} as g from e2)
select round(g1.ece, 6) as ece_before, round(g2.ece, 6) as ece_after, round(g1.ece - g2.ece, 6) as improvement,
  round((g1.ece - g2.ece) / greatest(g1.ece, 1e-10::double) * 100, 4) as improvement_pct, g1.g as grade_before, g2.g as grade_after from g1, g2""")
def _(t):
    from riskloom.functions.scores import recalibrated_single
    rows = judged(t)
    after = rows.withColumn("p", recalibrated_single(F.col("p")))
    out = metrics.calibration_report(metrics.calibration_error(rows, "y", "p"), metrics.calibration_error(after, "y", "p"))
    return out.select(*[F.round(c, 4 if c.endswith("pct") else 6).alias(c) for c in ("ece_before", "ece_after", "improvement", "improvement_pct")],
                      "grade_before", "grade_after")


@query("class_weights", f"""with {JUDGED_SQL}
select expected, count(*) as n, round((select count(*) from judged) / (3.0::double * count(*)), 6) as weight from judged group by expected""")
def _(t):
    return metrics.class_weights(judged(t), "expected", 3).withColumn("weight", F.round("weight", 6))


@query("metric_improvement", """
with m as (select c_mktsegment, c_nationkey % 4 as metric, avg(abs(c_acctbal)) / 10000 as old, max(abs(c_acctbal)) / 10000 as new from customer group by 1, 2)
select c_mktsegment, round(avg((new - old) / greatest(old, 0.001::double)), 6) as improvement, count(*) as metrics from m group by 1""")
def _(t):
    rows = t("customer").groupBy("c_mktsegment", (F.col("c_nationkey") % 4).alias("metric")).agg(
        (F.avg(F.abs("c_acctbal")) / 10000).alias("old"), (F.max(F.abs("c_acctbal")) / 10000).alias("new"))
    return metrics.mean_relative_gain(rows, "c_mktsegment", "old", "new").withColumn("improvement", F.round("improvement", 6))


@query("stratified_split", """
with h as (select doc_id, toxic, row_number() over (partition by toxic order by md5(toxic || '|' || doc_id)) as rn, count(*) over (partition by toxic) as n from labels)
select doc_id, toxic, case when rn <= floor(n * 0.8::double) then 'train' else 'val' end as split from h""")
def _(t):
    rows = t("labels").select("doc_id", "toxic")
    return ordered.hash_split(rows, ["toxic"], ordered.hash_order(F.col("toxic"), F.col("doc_id")), 0.8)


@query("random_split_and_f1", f"""with {JUDGED_SQL},
s as (select *, row_number() over (order by md5('42|' || doc_id)) > floor((select count(*) from judged) * 0.9::double) as val from judged),
v as (select * from s where val), {PR_SQL.replace('from judged', 'from v')}
select (select count(*) from v) as n, round((select avg((expected = predicted)::int) from v), 6) as accuracy,
  round(avg(f1) filter (support > 0), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from f""")
def _(t):
    rows = ordered.hash_split(judged(t).select("doc_id", "expected", "predicted"), [], ordered.hash_order(F.lit(42), F.col("doc_id")), 0.9)
    out = metrics.accuracy_summary(rows.filter("split = 'val'"), "expected", "predicted", fixed.LABELS)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query("positional_split", """
with h as (select event_id, row_number() over (order by md5('7|' || event_id)) as rn, count(*) over () as n from events)
select event_id, case when rn <= floor(n * 0.85::double) then 'train' else 'val' end as split from h""")
def _(t):
    return ordered.hash_split(t("events").select("event_id"), [], ordered.hash_order(F.lit(7), F.col("event_id")), 0.85)
