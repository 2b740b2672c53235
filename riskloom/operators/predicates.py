"""Row predicates and state rewrites used by ingest, review and retention jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed_platform(raw: Column, renames: Mapping[str, str], allowed: Sequence[str]) -> tuple[Column, Column]:
    """Canonical platform name and whether it is on the allow list."""
    name = F.lower(F.trim(raw))
    out = name
    for old, new in renames.items():
        out = F.when(name == old, new).otherwise(out)
    return out, out.isin(list(allowed))


def canonical_label(value: Column, labels: Sequence[str], default: str = "SUSPICIOUS") -> Column:
    """Upper-cased, trimmed text label; unknown ones become the default."""
    s = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(s.isin(list(labels)), s).otherwise(default)


def label_of_flag(value: Column) -> Column:
    """1 is a scam, every other number is safe."""
    return F.when(value == 1, "FAKE_SCAM").otherwise("SAFE")


def update_where_key(df: DataFrame, keys: DataFrame, on: str, changes: Mapping[str, Column]) -> DataFrame:
    """Rewrites columns of the rows whose key is in `keys`; all other rows pass unchanged."""
    marked = df.join(keys.select(on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return marked.select(*[
        F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
        for c in df.columns])


def expired(ts: Column, asof: Column | str, days: int) -> Column:
    """Older than `days` before the given clock."""
    clock = F.to_timestamp(F.lit(asof)) if isinstance(asof, str) else asof
    return ts < clock - F.make_interval(days=F.lit(days))
