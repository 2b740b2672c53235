"""Retention: what stays, what goes, and how many rows left each table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_rows(df: DataFrame, ts: str, clock: Column, days: int, protect: Column | None = None) -> DataFrame:
    """Rows young enough, or protected by status."""
    keep = F.col(ts) >= clock - F.make_interval(days=F.lit(days))
    return df.filter(keep | protect if protect is not None else keep)


def deleted_counts(tables: Mapping[str, tuple[DataFrame, str, Column | None]], clock: Column, days: int) -> DataFrame:
    """Rows each table loses: (table, deleted, kept). One aggregate per table."""
    out = None
    for name, (df, ts, protect) in tables.items():
        keep = F.col(ts) >= clock - F.make_interval(days=F.lit(days))
        keep = keep | protect if protect is not None else keep
        row = df.agg(F.count_if(~keep).alias("deleted"), F.count_if(keep).alias("kept")).select(
            F.lit(name).alias("table_name"), "deleted", "kept")
        out = row if out is None else out.unionByName(row)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Old and new rows with the newest version per key."""
    from riskloom.operators.ordered import latest_per_key

    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, [*version, "_new"]).drop("_new")
