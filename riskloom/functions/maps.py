"""Small map and array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_maps(left: Column, right: Column) -> Column:
    """Both maps in one; for a key in both, the right value stays."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def top_entries(scores: Column, floor: float, limit: int | None = None, wanted=None) -> Column:
    """Entries of a map at or above a floor, as (score, key) structs, best first; the first `limit` if one is given."""
    entries = F.transform(
        F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key")))
    kept = F.filter(entries, lambda e: (-e["neg"] >= floor) & (wanted(e["key"]) if wanted else F.lit(True)))
    ordered = F.array_sort(kept)
    return F.transform(
        ordered if limit is None else F.slice(ordered, 1, limit),
        lambda e: F.struct(e["key"].alias("key"), (-e["neg"]).alias("score")))
