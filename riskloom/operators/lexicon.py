"""Scorers driven by a lexicon that the caller passes in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.patterns import count_patterns, has_pattern, matched_words

Intent = tuple[str, float, Sequence[str]]


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Name of the first pattern that matches."""
    out = None
    for name, pattern in rules:
        test = has_pattern(text, pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def every_match(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Names of all patterns that match, in rule order."""
    return F.array_compact(F.array(*[F.when(has_pattern(text, p), F.lit(n)) for n, p in rules]))


def keyword_profile(
    df: DataFrame, text: str, keywords: Sequence[str], slang: Sequence[str],
    types: Sequence[tuple[str, Sequence[str]]], default_type: str = "suspicious_content",
) -> DataFrame:
    """Adds keywords found, capped additive score, slang flag and the type of the first rule hit."""
    from riskloom.functions.patterns import any_word

    found = df.withColumn("keywords", matched_words(F.lower(text), keywords))
    kind = None
    for name, words in types:
        test = F.arrays_overlap("keywords", F.array(*[F.lit(w) for w in words]))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return found.withColumns({
        "keyword_score": F.least(F.size("keywords") * F.lit(0.1), F.lit(1.0)),
        "has_slang": any_word(F.lower(text), slang),
        "scam_type": kind.otherwise(default_type),
    })


def intent_scores(df: DataFrame, text: str, intents: Sequence[Intent]) -> DataFrame:
    """Adds per-intent scores and their summary.

    A score is the matched patterns over 0.3 of the category's patterns (at least 1), at most 1.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    scored = df.withColumn("_low", low).withColumns({
        f"intent_{name}": F.round(
            F.least(count_patterns(F.col("_low"), pats) / F.lit(max(len(pats) * 0.3, 1.0)), F.lit(1.0)), 3)
        for name, _, pats in intents
    }).drop("_low")
    cols = [F.col(f"intent_{n}") for n, _, _ in intents]
    best = F.greatest(*cols) if len(cols) > 1 else cols[0]
    primary = None
    for (name, _, _), col in zip(intents, cols):
        primary = F.when(col == best, name) if primary is None else primary.when(col == best, name)
    weighted = sum((c * F.lit(w) for (_, w, _), c in zip(intents, cols)), F.lit(0.0))
    return scored.withColumns({
        "max_intent_score": best,
        "intent_count": sum(((c > 0.3).cast("int") for c in cols), F.lit(0)),
        "primary_intent": F.when(best > 0, primary).otherwise("none"),
        "risk_weighted_score": F.least(weighted / 2.0, F.lit(1.0)),
    })


def marker_scores(
    form: Column, markers: Mapping[str, str], floors: Sequence[tuple[Sequence[Sequence[str]], float]],
    step: float = 0.15,
) -> tuple[Column, Column]:
    """Marker names found in a matching form and their score.

    `floors` lists (groups, value): when each group has a marker present, the score is at least value.
    """
    hits = every_match(form, list(markers.items()))

    def has(names):
        return F.arrays_overlap(hits, F.array(*[F.lit(n) for n in names]))

    score = F.least(F.size(hits) * F.lit(step), F.lit(1.0))
    for groups, value in floors:
        test = F.lit(True)
        for group in groups:
            test = test & has(group)
        score = F.when(test, F.greatest(score, F.lit(value))).otherwise(score)
    return hits, score
