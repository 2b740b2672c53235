"""Roll-ups of per-item evidence scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_rollup(frames: DataFrame, key: str) -> DataFrame:
    """Mean frame score per item with capped boosts for bad codes and text hits.

    Input columns: score, bad_codes, intent_hits, keyword_hits (counts per frame).
    """
    sums = frames.groupBy(key).agg(
        F.count(F.lit(1)).alias("frames"), F.avg("score").alias("mean_score"),
        F.count_if(F.col("score") > 0.5).alias("flagged"), F.sum("bad_codes").alias("_codes"),
        F.sum("intent_hits").alias("_intents"), F.sum("keyword_hits").alias("_words"))
    code_boost = F.least(F.col("_codes") * F.lit(0.15), F.lit(0.4))
    text_risk = F.least(F.col("_intents") * F.lit(0.12) + F.col("_words") * F.lit(0.08), F.lit(0.75))
    text_boost = F.least(text_risk, F.lit(0.5))
    return sums.select(
        key, "frames", "mean_score", "flagged", text_risk.alias("text_risk"),
        F.least(F.col("mean_score") + code_boost + text_boost, F.lit(1.0)).alias("confidence"),
        ((F.col("flagged") / F.col("frames") > 0.3) | (code_boost > 0) | (text_boost > 0.1)).alias("is_flagged"))
