"""Counts, shares, crosstabs, histograms and exact quantiles over tables of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import written


def group_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def with_share(counts: DataFrame, name: str = "n", share: str = "pct") -> DataFrame:
    """Adds each count's percentage of all counts; the total is a scalar subquery, not a join."""
    total = counts.agg(F.sum(name)).scalar()
    return counts.withColumn(share, F.round(F.lit(100.0) * F.col(name) / total, 6))


def distributions(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Value counts of several columns from one scan and one shuffle, as (dimension, value, n)."""
    pairs = [
        F.struct(
            F.lit(name).alias("dimension"),
            (F.col(col) if isinstance(col, str) else col).cast("string").alias("value"),
        )
        for name, col in columns.items()
    ]
    return (
        df.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.dimension", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence, prefix: str = "") -> DataFrame:
    """Two-way counts with a fixed, zero-filled column list: one pass, no value discovery job."""
    cells = [
        F.count_if(F.col(columns) == F.lit(v)).alias(f"{prefix}{v}") for v in values
    ]
    return df.groupBy(rows).agg(*cells)


def prevalence(df: DataFrame, group: str, flags: Sequence[str]) -> DataFrame:
    """Percentage of true per flag and group."""
    return df.groupBy(group).agg(
        *[F.round(F.avg(F.col(f).cast("double")) * 100, 6).alias(f"{f}_pct") for f in flags]
    )


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width counts between the minimum and maximum, last bin closed, empty bins kept."""
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo = F.when(span["lo"] == span["hi"], span["lo"] - 0.5).otherwise(span["lo"])
    hi = F.when(span["lo"] == span["hi"], span["hi"] + 0.5).otherwise(span["hi"])
    place = F.floor((F.col(value) - lo) / (hi - lo) * bins).cast("int")
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


#: Counted cells a bracket is cut into per round.
CELLS = 1024


def _cell(v: str, lo: str, hi: str) -> Column:
    """Cell of a value within [lo, hi]: both ends have cells of their own, so a bracket of two values always splits."""
    x, a, b = F.col(v), F.col(lo), F.col(hi)
    # Halves, so that the width of any two finite numbers is finite.
    place = F.floor((x / 2 - a / 2) / (b / 2 - a / 2) * (CELLS - 2)).cast("int")
    return F.when(x == a, 0).when(x == b, CELLS - 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(CELLS - 2), F.coalesce(place, F.lit(1)))))


def _narrowed(targets: DataFrame, cells: DataFrame, on: list[str], key: str) -> DataFrame:
    """Targets (key, r, below, lo, hi) moved to the counted cell (c, n, lo, hi) that holds rank r."""
    listed = cells.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("c", "n", "lo", "hi"))).alias("cells"))
    # At most CELLS entries a list.
    start = F.struct(F.col("below").alias("below"), F.lit(None).cast("struct<c:int,n:bigint,lo:double,hi:double>").alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["hit"].isNull() & (F.col("r") < acc["below"] + x["n"])
        return F.struct(F.when(acc["hit"].isNull() & ~here, acc["below"] + x["n"]).otherwise(acc["below"]).alias("below"),
                        F.when(here, x).otherwise(acc["hit"]).alias("hit"))

    found = targets.join(listed, on).withColumn("_at", F.aggregate("cells", start, step))
    return found.select(key, "r", F.col("_at.below").alias("below"), F.col("_at.hit.lo").alias("lo"), F.col("_at.hit.hi").alias("hi"))


def values_at_ranks(rows: DataFrame, key: str, value: str, ranks: DataFrame, most_rounds: int = 400) -> DataFrame:
    """(key, r, value): the value at rank r (from 0, ascending) of each key, exact. `rows` has no null values; `ranks`: key, r.

    Rounds of refinement: values between the ends of a rank's bracket are counted in cells, before the shuffle, and the
    cell that holds the rank becomes the bracket, with the least and greatest value found in it as its ends. A bracket of one
    value is done. Neither a key nor a bracket is ever gathered or sorted, and each round reads only what its brackets hold.
    """
    v = rows.select(F.col(key), F.col(value).cast("double").alias("v"))
    span = v.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # The first cells are the same for all ranks of a key: one count serves them all.
    first = v.join(span, key).groupBy(key, _cell("v", "lo", "hi").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    targets = written(_narrowed(ranks.select(key, "r", F.lit(0).cast("long").alias("below")), first, [key], key), "ranks")
    for _ in range(most_rounds):
        open_ones = targets.where("lo < hi")
        if open_ones.isEmpty():
            return targets.select(key, "r", F.col("lo").alias("value"))
        inside = v.join(open_ones, key).where("v >= lo and v <= hi")
        cells = inside.groupBy(key, "r", _cell("v", "lo", "hi").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        moved = _narrowed(open_ones.select(key, "r", "below"), cells, [key, "r"], key)
        targets = written(moved.unionByName(targets.where("lo = hi")), "ranks")
    raise RuntimeError("brackets did not close")


def exact_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float]) -> DataFrame:
    """(key, p, q): linear-interpolated quantiles per key, exact, without gathering a key in one place."""
    rows = df.select(key, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    sizes = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "sizes")
    h = (F.col("n") - 1) * F.col("p")
    wanted = sizes.select(key, "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")).select(
        key, "p", F.floor(h).alias("r0"), F.ceil(h).alias("r1"), (h - F.floor(h)).alias("frac"))
    ranks = wanted.select(key, F.explode(F.array("r0", "r1")).alias("r")).distinct()
    at = values_at_ranks(rows, key, "_v", ranks)
    low, high = at.select(key, F.col("r").alias("r0"), F.col("value").alias("a")), at.select(key, F.col("r").alias("r1"), F.col("value").alias("b"))
    both = wanted.join(low, [key, "r0"]).join(high, [key, "r1"])
    # Equal neighbours need no step between them; infinite ones would make it undefined.
    return both.select(key, "p", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")).alias("q"))


def box_statistics(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles and the outermost values within 1.5 interquartile ranges, per key."""
    quartiles = exact_quantiles(df, key, value, (0.25, 0.5, 0.75)).groupBy(key).agg(*[
        F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
        for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col(value)
    return df.join(quartiles, key).groupBy(key, "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
    )


def length_profile(df: DataFrame, text: str, group: str | None = None) -> DataFrame:
    size = F.length(text)
    frame = df.groupBy(group) if group else df.groupBy()
    return frame.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(size), 6).alias("avg_length"),
        F.min(size).cast("long").alias("min_length"), F.max(size).cast("long").alias("max_length"))
