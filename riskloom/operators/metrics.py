"""Classification and calibration metrics in one or two aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fixed
from riskloom.operators.reports import ratio


def confusion_matrix(df: DataFrame, expected: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Counts per (expected, predicted), zero filled over the label list."""
    cells = [
        F.struct(F.lit(e).alias("expected"), *[
            F.count_if((F.col(expected) == e) & (F.col(predicted) == p)).alias(p) for p in labels])
        for e in labels
    ]
    return df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))


def _class_counts(df: DataFrame, expected: str, predicted: str, labels: Sequence[str], *keys: str) -> DataFrame:
    e, p = F.col(expected), F.col(predicted)
    rows = [
        F.struct(
            F.lit(label).alias("label"), F.count_if((e == label) & (p == label)).alias("tp"),
            F.count_if(p == label).alias("n_predicted"), F.count_if(e == label).alias("support"))
        for label in labels
    ]
    frame = df.groupBy(*keys) if keys else df.groupBy()
    return frame.agg(
        F.array(*rows).alias("rows"), F.count(F.lit(1)).alias("n"), F.count_if(e == p).alias("correct"))


def _scores(c) -> tuple[Column, Column, Column]:
    precision = ratio(c["tp"], c["n_predicted"])
    recall = ratio(c["tp"], c["support"])
    return precision, recall, ratio(2 * precision * recall, precision + recall)


def class_metrics(df: DataFrame, expected: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where a denominator is 0."""
    rows = _class_counts(df, expected, predicted, labels).select(F.inline("rows"))
    precision, recall, f1 = _scores({c: F.col(c) for c in ("tp", "n_predicted", "support")})
    return rows.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def accuracy_summary(df: DataFrame, expected: str, predicted: str, labels: Sequence[str], *keys: str) -> DataFrame:
    """Accuracy, macro F1 over labels with support, and support-weighted F1."""
    counts = _class_counts(df, expected, predicted, labels, *keys)
    f1 = F.transform("rows", lambda r: F.struct(_scores(r)[2].alias("f1"), r["support"].alias("support")))
    scored = counts.withColumn("f", f1)
    zero = F.lit(0.0)

    def total(expr):
        return F.aggregate("f", zero, lambda acc, x: acc + expr(x))

    present = F.size(F.filter("f", lambda x: x["support"] > 0))
    return scored.select(
        *keys, "n", ratio(F.col("correct"), F.col("n")).alias("accuracy"),
        ratio(total(lambda x: F.when(x["support"] > 0, x["f1"]).otherwise(zero)), present).alias("macro_f1"),
        ratio(total(lambda x: x["f1"] * x["support"]), total(lambda x: x["support"].cast("double"))).alias("weighted_f1"))


def accuracy_by_domain(df: DataFrame, domain: str, expected: str, predicted: str) -> DataFrame:
    hit = F.col(expected) == F.col(predicted)
    missed = (F.col(expected) == "FAKE_SCAM") & (F.col(predicted) == "SAFE")
    return df.groupBy(domain).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy"),
        F.count_if(missed).alias("scam_as_safe"))


def calibration_bins(df: DataFrame, truth: str, prob: str, bins: int = 10) -> DataFrame:
    """Bin statistics over half-open bins (lo, hi]; a probability of 0 is in no bin."""
    p = F.col(prob)
    place = F.lit(0)
    for i in range(bins):
        place = place + (p > F.lit(i * (1.0 / bins))).cast("int")
    gap = F.abs(F.avg(p) - F.avg(truth))
    return (
        df.filter(p <= 1).groupBy(place.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(truth).alias("accuracy"), F.avg(p).alias("avg_confidence"), gap.alias("gap"))
        .filter("bin > 0"))


def calibration_grade(ece: Column) -> Column:
    out = None
    for bound, grade in fixed.CALIBRATION_GRADES:
        if bound is None:
            return out.otherwise(grade)
        out = F.when(ece < bound, grade) if out is None else out.when(ece < bound, grade)


def calibration_error(df: DataFrame, truth: str, prob: str, bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error. Shares count every row, also those in no bin."""
    stats = calibration_bins(df, truth, prob, bins)
    total = df.agg(F.count(F.lit(1))).scalar()
    ece = F.coalesce(F.sum(F.col("n") / total * F.col("gap")), F.lit(0.0))
    out = stats.agg(ece.alias("ece"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("mce"), F.count(F.lit(1)).alias("bins_used"))
    return out.withColumn("grade", calibration_grade(F.col("ece")))


def calibration_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row from two calibration_error results: gain in points and percent, with grades."""
    b, a = before.select(F.struct("ece", "grade")).scalar(), after.select(F.struct("ece", "grade")).scalar()
    base = before.select("bins_used")
    gain = b["ece"] - a["ece"]
    return base.select(
        b["ece"].alias("ece_before"), a["ece"].alias("ece_after"), gain.alias("improvement"),
        (gain / F.greatest(b["ece"], F.lit(1e-10)) * 100).alias("improvement_pct"),
        b["grade"].alias("grade_before"), a["grade"].alias("grade_after"))


def class_weights(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """n / (k * count) per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("weight", total / (F.lit(float(n_classes)) * F.greatest("n", F.lit(1))))


def mean_relative_gain(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Mean of (new - old) / max(old, 0.001) over the metric rows of each run."""
    gain = (F.col(new) - F.col(old)) / F.greatest(F.col(old), F.lit(0.001))
    return df.groupBy(key).agg(F.avg(gain).alias("improvement"), F.count(F.lit(1)).alias("metrics"))
