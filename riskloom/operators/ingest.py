"""Quarantine and metadata projection of incoming posts. Works on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fixed
from riskloom.functions.patterns import any_pattern, has_pattern
from riskloom.functions.text import content_hash, digit_substitution_share
from riskloom.operators.lexicon import keyword_profile


def quarantine(
    df: DataFrame, key: str, text: str, patterns: Sequence[str] = fixed.QUARANTINE_PATTERNS
) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, audit rows of the rest). Audit rows hold a digest and the reason, no content."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    reason = None
    for p in patterns:
        reason = F.when(has_pattern(low, p), p) if reason is None else reason.when(has_pattern(low, p), p)
    harmful = any_pattern(low, patterns)
    held = df.filter(harmful).select(key, content_hash(F.col(text)).alias("digest"), reason.alias("reason"))
    return df.filter(~harmful), held


def post_metadata(
    df: DataFrame, key: str, text: str, clock: Column,
    keywords: Sequence[str] = fixed.KEYWORDS, slang: Sequence[str] = fixed.KEYWORD_SLANG,
    types: Sequence[tuple[str, Sequence[str]]] = fixed.KEYWORD_TYPES, prefix: str = "meta_",
    source: str = "research", retention_days: int = 30,
) -> DataFrame:
    """One metadata row per post: identity, digest, scores, type, keywords and expiry; no content."""
    scored = keyword_profile(df, text, keywords, slang, types)
    return scored.select(
        F.concat(F.lit(prefix), F.coalesce(F.col(key).cast("string"), F.lit("unknown"))).alias("post_id"),
        F.lit(source).alias("platform"), F.lit("text").alias("content_type"),
        content_hash(F.col(text)).alias("content_hash"), F.lit(False).alias("is_quarantined"),
        F.col("keyword_score").alias("scam_probability"), "scam_type", F.lit(0.85).alias("confidence_score"),
        F.col("has_slang").alias("contains_slang"), digit_substitution_share(F.col(text)).alias("leetspeak_score"),
        F.col("keywords").alias("detected_keywords"), F.lit(1).alias("propagation_depth"),
        clock.alias("created_at"),
        (clock + F.make_interval(days=F.lit(retention_days))).alias("retention_expires"))
