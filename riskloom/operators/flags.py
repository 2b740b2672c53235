"""Helpers over arrays of flag codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def highlight_keywords(flags: Column, tiers: Sequence[str]) -> Column:
    """Words to mark in a text: tier words plus the detail part of each flag, longest first."""
    details = F.transform(
        F.filter(flags, lambda f: F.contains(f, F.lit(":"))),
        lambda f: F.translate(F.split_part(f, F.lit(":"), F.lit(2)), "_", " "))
    words = F.filter(F.array_union(F.array(*[F.lit(w) for w in tiers]), details), lambda w: w != "")
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(ranked, lambda r: r["w"])
