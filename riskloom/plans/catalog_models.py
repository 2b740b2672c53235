"""Classifiers, cross-validation, batch scoring and the experiment table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions.patterns import count_words
from riskloom.operators import metrics, models
from riskloom.plans import fixture as fx
from riskloom.plans.registry import query
from riskloom.session import fresh_path, spread, written

FEATURES = ["n_chars", "caps", "substitution", "digits", "keywords", "insults"]


def _rows(t):
    """Feature rows of labelled documents, computed once."""
    low = F.lower("text")
    docs = spread(t("documents")).join(t("labels"), "doc_id")
    rows = docs.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), tx.upper_ratio(F.col("text")).alias("caps"),
        tx.substitution_density(F.col("text")).alias("substitution"), tx.digit_form_share(F.col("text")).alias("digits"),
        count_words(low, fx.KEYWORDS).cast("double").alias("keywords"),
        count_words(low, ["worthless", "pathetic", "stupid", "idiot", "loser"]).cast("double").alias("insults"),
        F.col("toxic").cast("double").alias("y"))
    return written(rows, "features")


def _trained(t, rows):
    weights = metrics.class_weights(rows, "y", 2).select("y", "weight")
    return models.forest(FEATURES, "y", "weight").fit(rows.join(weights, "y"))


@query("forest_predictions")
def _(t):
    rows = _rows(t)
    return _trained(t, rows).transform(rows).select("doc_id", "y", "prediction")


@query("feature_importance")
def _(t):
    rows = _rows(t)
    return models.feature_importance(_trained(t, rows), FEATURES)


@query("cross_validated_accuracy")
def _(t):
    rows = _rows(t)
    score = models.cross_validated(models.forest(FEATURES, "y", trees=10, depth=4), rows, "y")
    return rows.groupBy(F.lit("forest").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.lit(round(score, 6)).alias("accuracy"))


@query("text_classifier_predictions")
def _(t):
    rows = t("documents").join(t("labels"), "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("y"))
    return models.text_classifier("text", "y").fit(rows).transform(rows).select("doc_id", "y", "prediction")


@query("batch_scoring_with_status")
def _(t):
    rows = _rows(t)
    scored = models.score_rows(_trained(t, rows), rows.withColumn(
        "caps", F.when(F.col("n_chars") > 40, F.col("caps"))), F.col("caps").isNotNull())
    return scored.select("doc_id", "prediction", "status")


#: Marks of a text counted by the batched model.
MEASURES = ["[A-Z]", "!", "[|]", "[#$%&*]", "worthless|pathetic|stupid|idiot|loser"]


def _discriminant_sql() -> str:
    """The same model written out: pooled variances, linear scores, softmax."""
    size = "length(text)"
    shares = [f"coalesce(len(regexp_extract_all(text, {fx.quoted(p)})) / nullif({size}, 0)::double, 0.0)" for p in MEASURES] + [f"{size} / 1000.0::double"]
    names = [f"x{i}" for i in range(len(shares))]
    offset = " + ".join(f"m{i} * m{i} * p{i}" for i in range(len(names)))
    return f"""
with x as (select doc_id, text, {', '.join(f'{e} as {n}' for e, n in zip(shares, names))} from documents),
l as (select case when toxic = 1 then 'FAKE_SCAM' when quality = 0 then 'SUSPICIOUS' else 'SAFE' end as label, x.* from labels join x using (doc_id) where text is not null),
s as (select label, count(*)::double as n, {', '.join(f'avg({n}) as m{i}, var_pop({n}) as v{i}' for i, n in enumerate(names))} from l group by 1),
p as (select sum(n) as total, {', '.join(f'case when sum(n * v{i}) / sum(n) > 1e-12 then sum(n) / sum(n * v{i}) else 0 end as p{i}' for i in range(len(names)))} from s),
z as (select doc_id, label, ln(n / total) - 0.5 * ({offset}) + {' + '.join(f'x{i} * m{i} * p{i}' for i in range(len(names)))} as z from x, s, p where text is not null),
g as (select doc_id, label, exp(z - max(z) over (partition by doc_id)) as g from z),
e as (select doc_id, label, g / sum(g) over (partition by doc_id) as share from g),
b as (select doc_id, arg_max(label, (share, label)) as prediction, max(share) as confidence, max(share) filter (label = 'SAFE') as safe_share from e group by 1)
select x.doc_id, coalesce(prediction, 'ERROR') as prediction, round(coalesce(confidence, 0.0), 5) as confidence, round(safe_share, 5) as safe_share,
  coalesce(prediction = 'SAFE', false) as is_safe, prediction is null or (prediction <> 'SAFE' and confidence < 0.8) as requires_review,
  case when prediction is null then 'error' else 'ok' end as status from x left join b using (doc_id)"""


@query("batched_model_scores", _discriminant_sql())
def _(t):
    label = F.when(F.col("toxic") == 1, "FAKE_SCAM").when(F.col("quality") == 0, "SUSPICIOUS").otherwise("SAFE")
    known = t.wide("documents").join(t("labels").select("doc_id", label.alias("label")), "doc_id")
    model = models.fit_discriminant(known, "text", "label", MEASURES)
    # The fitted weights travel with the function: a few numbers. A larger model would be read by `load`, once a task.
    scored = models.score_batches(t.wide("documents"), ["doc_id"], "text", lambda: model, model.labels, "SAFE")
    return scored.select("doc_id", "prediction", F.round("confidence", 5).alias("confidence"), F.round(F.col("probabilities")["SAFE"], 5).alias("safe_share"),
                         "is_safe", "requires_review", "status")


@query("experiment_metrics")
def _(t):
    rows = _rows(t)
    scored = _trained(t, rows).transform(rows).select(F.col("y").cast("int").cast("string").alias("e"), F.col("prediction").cast("int").cast("string").alias("p"))
    summary = metrics.accuracy_summary(scored, "e", "p", ["0", "1"])
    path = fresh_path(t.spark, "experiments")
    summary.select(F.lit("run-1").alias("run"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "macro_f1", "weighted_f1")]))).write.mode("append").parquet(path)
    return t.spark.read.schema("run string, metric string, value double").parquet(path)
