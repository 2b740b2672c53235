"""Ordered work per key that stays parallel when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key. An aggregate, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, same: Column, order: Sequence[str]) -> DataFrame:
    """First row among equal content. Grouped on a digest, so long texts are not shuffle keys."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(F.sha2(same, 256).alias("_digest")).agg(first).select("_row.*")


def recent_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key; Spark trims each partition to n per key before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def means_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(keys..., mean): the mean per key, its values added one after the other in `order`.

    A sum of doubles depends on the order they are added in, and a mean that lies on a tie of the digit it is rounded to shows it.
    A running sum adds row by row and spills if a key has many, so the result does not depend on how the rows are dealt.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = Window.partitionBy(*keys).orderBy(*order)
    running = df.select(*keys, F.sum(value).over(before).alias("_sum"), F.count(value).over(before).alias("_n"), F.row_number().over(place).alias("_at"))
    last = running.groupBy(*keys).agg(F.max_by(F.struct("_sum", "_n"), "_at").alias("_last"))
    return last.select(*keys, F.try_divide("_last._sum", "_last._n").alias("mean"))


def recent_with_totals(df: DataFrame, key: str, order: Sequence[Column], n: int, totals: Sequence[str]) -> DataFrame:
    """First n rows per key in `order`, newest first; each column of `totals` becomes its running sum from the oldest row on.

    A running sum is the key's whole sum without the newer rows, which are all among the n: whole keys are summed
    before the shuffle and only n rows of each are ordered.
    """
    ring = recent_n(df, [key], order, n)
    sums = df.groupBy(F.col(key).alias("_owner")).agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
    newer = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    running = {c: F.col(f"_sum_{c}") - F.coalesce(F.sum(c).over(newer), F.lit(0)) for c in totals}
    return ring.join(sums, F.col(key).eqNullSafe(F.col("_owner"))).withColumns(running).select(*df.columns, "rank")


def with_position(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """1-based position of each row per key.

    `bucket` must grow with `order`. Rows are numbered inside (key, bucket) and shifted by the
    count of earlier buckets, so no task ever sorts a whole key.
    """
    cut = df.withColumn("_bucket", bucket)
    on = [*keys, "_bucket"]
    sizes = cut.groupBy(*on).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*on, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    return (
        cut.join(starts, on)
        .withColumn(name, F.col("_start") + inside)
        .drop("_bucket", "_start")
        .select(*df.columns, name)
    )


def running_total(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Running sums per key in order, built from bucket totals plus sums inside each bucket."""
    cut = df.withColumn("_bucket", bucket)
    on = [*keys, "_bucket"]
    sums = cut.groupBy(*on).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *on, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in totals]
    )
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(starts, on).select(
        *df.columns,
        *[(F.col(f"_start_{n}") + F.sum(c).over(inside)).alias(n) for n, c in totals.items()],
    )


def hash_order(*parts: Column) -> Column:
    """A seeded order that any engine reproduces: the md5 text of the joined parts."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_split(df: DataFrame, strata: Sequence[str], digest: Column, share: float) -> DataFrame:
    """Positional train/validation split in hash order, per stratum (none = over all rows)."""
    marked = df.withColumn("_digest", digest)
    # 4096 buckets by the first digits of the digest: evenly filled, and their counts are few rows.
    placed = with_position(marked, list(strata), F.substring("_digest", 1, 3), [F.col("_digest")])
    if strata:
        sizes = marked.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
        placed = placed.join(sizes, list(strata))
    else:
        placed = placed.withColumn("_n", marked.agg(F.count(F.lit(1))).scalar())
    split = F.when(F.col("position") <= F.floor(F.col("_n") * F.lit(share)), "train").otherwise("val")
    return placed.withColumn("split", split).select(*df.columns, "split")


def joined_in_order(
    df: DataFrame, keys: Sequence[str], order: str, text: str, separator: str = " ", chunk: int = 512
) -> DataFrame:
    """Text pieces of each key joined in order, assembled from runs of `chunk` positions."""
    def glue(items: str, first: str) -> Column:
        return F.array_join(F.transform(F.array_sort(items), lambda x: x[first]), separator)

    runs = df.groupBy(*keys, F.floor(F.col(order) / chunk).alias("_run")).agg(
        F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("s"))).alias("_items"),
        F.count(F.lit(1)).alias("_pieces"),
    ).select(*keys, "_run", "_pieces", glue("_items", "s").alias("_text"))
    return runs.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("_run").alias("o"), F.col("_text").alias("s"))).alias("_items"),
        F.sum("_pieces").alias("pieces"),
    ).select(*keys, glue("_items", "s").alias(text), "pieces")
