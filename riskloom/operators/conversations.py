"""Scores of conversations from their turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.patterns import any_word, count_words
from riskloom.operators.ordered import with_position


def language_variant(text: Column, slang: Sequence[str], gaming: Sequence[str]) -> Column:
    low = F.lower(text)
    return (
        F.when(count_words(low, slang) > 3, "teencode_heavy")
        .when(count_words(low, gaming) > 2, "gaming_focused").otherwise("mixed"))


def realism_score(turns: DataFrame, roles: Sequence[str], slang: Sequence[str]) -> DataFrame:
    """Mean of four factors: roles alternate, slang share in range, three turns, and one unused."""
    placed = with_position(
        turns.select("conv_id", "turn", "role", any_word(F.lower("text"), slang).alias("_slang")),
        ["conv_id"], F.floor(F.col("turn") / 512), [F.col("turn")])
    expected = F.element_at(F.array(*[F.lit(r) for r in roles]), ((F.col("position") - 1) % len(roles) + 1).cast("int"))
    share = F.avg(F.col("_slang").cast("double"))
    factors = [F.bool_and(F.col("role") == expected), (share >= 0.2) & (share <= 0.6), F.count(F.lit(1)) >= 3]
    total = sum((f.cast("double") for f in factors), F.lit(0.0)) / 4
    return placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), total.alias("realism"))
