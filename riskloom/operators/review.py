"""Review queue: priorities, batches, status moves, retraining candidates and pattern weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scores import review_priority
from riskloom.operators.ordered import joined_in_order

CONFIDENCE_FLOOR = 0.7
DRIFT_BOUND = 0.15


def needs_review(confidence: Column, is_new: Column, drift: Column, kind: Column) -> Column:
    return (
        (confidence < CONFIDENCE_FLOOR) | is_new | (drift > DRIFT_BOUND)
        | F.coalesce(kind.isin("high_entropy", "disagreement"), F.lit(False)))


def enqueue(df: DataFrame, clock: Column, hours: int = 24) -> DataFrame:
    """Queue rows with priority, pending status and deadline.

    Input: item_id, item_type, model_confidence, is_new_pattern, drift_score, n_new_keywords.
    """
    return df.withColumns({
        "priority_score": review_priority(
            F.col("model_confidence"), F.col("is_new_pattern"), F.col("drift_score"), F.col("n_new_keywords"), CONFIDENCE_FLOOR),
        "review_status": F.lit("pending"), "created_at": clock,
        "review_deadline": clock + F.make_interval(hours=F.lit(hours)), "used_in_retraining": F.lit(False),
    })


def review_batch(queue: DataFrame, n: int = 50) -> DataFrame:
    """The n pending rows of highest priority, oldest first on ties."""
    return queue.filter("review_status = 'pending'").orderBy(F.desc("priority_score"), "created_at", "item_id").limit(n)


def take_batch(queue: DataFrame, n: int = 50) -> DataFrame:
    """The queue after its next batch moved to in_review."""
    taken = review_batch(queue, n).select("item_id", F.lit(True).alias("_taken"))
    return queue.join(taken, "item_id", "left").withColumn(
        "review_status", F.when(F.col("_taken"), "in_review").otherwise(F.col("review_status"))).drop("_taken")


def retraining_candidates(queue: DataFrame) -> DataFrame:
    return queue.filter(
        (F.col("review_status") == "completed") & ~F.col("used_in_retraining") & (F.col("human_confidence") >= 0.7))


def retrain_trigger(candidates: DataFrame, enough: int = 100, enough_drift: int = 20) -> DataFrame:
    """One row: candidate counts and whether they call for a new model."""
    n, drifted = F.count(F.lit(1)), F.count_if(F.col("drift_score") > DRIFT_BOUND)
    return candidates.agg(
        n.alias("candidates"), drifted.alias("drifted"), ((n >= enough) | (drifted >= enough_drift)).alias("retrain"))


def training_texts(candidates: DataFrame, turns: DataFrame, speaker: str, bad: Sequence[str]) -> DataFrame:
    """Text and 0/1 label per candidate; conversations contribute the turns of one speaker."""
    spoken = joined_in_order(turns.filter(F.col("role") == speaker), ["conv_id"], "turn", "text").select(
        F.col("conv_id").alias("item_id"), F.col("text").alias("_spoken"))
    label = F.lower(F.coalesce("human_label", F.lit("legitimate"))).isin(list(bad)).cast("int")
    return (
        candidates.join(spoken, "item_id", "left")
        .select("item_id", F.when(F.col("item_type") == "conversation", F.col("_spoken")).otherwise(F.col("text")).alias("text"),
                label.alias("label"))
        .filter("text is not null and text <> ''"))


def pattern_weights(items: DataFrame, words: Mapping[str, str]) -> DataFrame:
    """Summed human confidence per word over several array columns, scaled to a maximum of 1.

    `words` maps an array column to the field that holds its word ('' for plain strings).
    """
    parts = [
        items.select(
            F.explode(F.transform(col, (lambda x, f=None: x) if not field else _field(field))).alias("word"), "human_confidence")
        for col, field in words.items()
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    sums = both.groupBy("word").agg(F.sum("human_confidence").alias("raw"))
    top = sums.agg(F.max("raw")).scalar()
    return sums.select("word", "raw", (F.col("raw") / top).alias("weight"))


def _field(name: str):
    return lambda x: x[name]
