"""New keywords and emerging patterns against a known set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fixed
from riskloom.functions.patterns import any_word
from riskloom.functions.text import in_context


def severity(pattern: Column, high: Sequence[str] = fixed.SEVERITY_HIGH, medium: Sequence[str] = fixed.SEVERITY_MEDIUM) -> Column:
    low = F.lower(pattern)
    return F.when(any_word(low, high), "high").when(any_word(low, medium), "medium").otherwise("low")


def drift_hits(df: DataFrame, key: str, text: str, groups: Mapping[str, Sequence[str]], kind: str,
               context: int | None = None) -> DataFrame:
    """One row per (text, group word) found: key, kind, group, word and optionally its context."""
    low = F.lower(F.col(text))
    entries = [
        F.when(F.contains(low, F.lit(w)), F.struct(
            F.lit(kind).alias("kind"), F.lit(group).alias("group"), F.lit(w).alias("word"),
            (in_context(F.col(text), w, context) if context else F.lit(None).cast("string")).alias("context")))
        for group, words in groups.items() for w in words
    ]
    return df.select(key, F.explode(F.array_compact(F.array(*entries))).alias("h")).select(key, "h.*")


def new_keywords(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Hits whose word is not in the known set."""
    return hits.join(known.select("word").distinct(), "word", "left_anti")


def drift_profile(df: DataFrame, key: str, keyword_hits: DataFrame, pattern_hits: DataFrame) -> DataFrame:
    """Per text: number of new keywords and patterns, drift score, confidence and the new flag."""
    both = keyword_hits.select(key, F.lit(1).alias("k"), F.lit(0).alias("p")).unionByName(
        pattern_hits.select(key, F.lit(0).alias("k"), F.lit(1).alias("p")))
    counts = both.groupBy(key).agg(F.sum("k").alias("n_new_keywords"), F.sum("p").alias("n_new_patterns"))
    k, p = F.coalesce("n_new_keywords", F.lit(0)), F.coalesce("n_new_patterns", F.lit(0))
    drift = F.least(k * F.lit(0.1) + p * F.lit(0.15), F.lit(1.0))
    return df.select(key).join(counts, key, "left").select(
        key, k.alias("n_new_keywords"), p.alias("n_new_patterns"), ((k + p) > 0).alias("is_new_pattern"),
        drift.alias("drift_score"),
        F.least(drift + k * F.lit(0.1) + p * F.lit(0.15), F.lit(1.0)).alias("confidence"))
