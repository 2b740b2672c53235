"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated up to three times. Every pass of a document has its own
virtual start and finish time: the words queued before it, and with it, divided by the source's target. All passes are put
in one global order by virtual time and cut where the words served come to the budget; a pass in service at the cut is taken
up to it, word by word.

The global order is a range sort by counting: virtual time is dealt into cells, each pass adds its words to the cells it is
in service in, the running total over the cells names the one the budget ends in, and that one is dealt again. So no task
holds the order, and a round returns one number a cell.

Running sums are taken inside hash buckets of a source and shifted by the sums of the buckets before, so no task holds a
whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.columns import Carried, space_words, text_key, whole
from riskloom.session import written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Rows of a source's bucket, on the average, before the number of buckets grows with the root of the rows.
BUCKET_ROWS = 256
#: Cells of virtual time a round; rounds go on until the cut is found to a word or a cell is as narrow as a double.
CELLS = 1024


def order_key() -> Column:
    """The shuffle: documents in order of the hash of their id; null ids come last, in order of the hash of their text."""
    return F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.concat(F.lit("~"), text_key(whole("text"))))


def targets(sizes: DataFrame) -> DataFrame:
    """`sizes` (source, source_size and more, one row per source; null is a source) with each source's target.

    A source's share by weight stops at three times its size and what is over is shared again. With sources in order of
    size per weight, the ones that stop are a prefix, so one running sum decides: the fill level is the first at which the
    rest divides among the rest without anyone stopping.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    frame = sizes.withColumn("w", weight).withColumn("top", F.col("source_size") * F.lit(float(MAX_REPEATS)))
    up = Window.orderBy((F.col("top") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    frame = frame.withColumns({
        "before_top": F.coalesce(F.sum("top").over(up), F.lit(0.0)), "before_w": F.coalesce(F.sum("w").over(up), F.lit(0.0)),
        "all_w": F.sum("w").over(every), "total": F.sum("source_size").over(every)})
    level = (F.col("total") - F.col("before_top")) / (F.col("all_w") - F.col("before_w"))
    # The level of the first source that does not stop; later sources do not stop either.
    frame = frame.withColumn("own", F.when(F.col("top") / F.col("w") >= level, level)).withColumn("stops", F.col("own").isNull())
    frame = frame.withColumn("level", F.min(F.when(~F.col("stops"), F.struct("before_w", "own"))).over(every)["own"])
    return frame.select(*sizes.columns, F.least("top", F.coalesce(F.col("level") * F.col("w"), F.col("top"))).alias("target"))


def _queued(frame: DataFrame, buckets: int) -> DataFrame:
    """`frame` (_k, _order, _tie, size) with _queued: the words of the documents of its source that come before."""
    nulls = F.substring("_order", 1, 1) == "~"
    place = F.conv(F.substring("_order", F.when(nulls, 2).otherwise(1), F.lit(4)), 16, 10).cast("int")
    frame = frame.withColumn("_bucket", F.floor(place / F.lit(65536 // buckets)).cast("int") + F.when(nulls, buckets).otherwise(0))
    ahead = frame.groupBy("_k", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.withColumn("_ahead", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_k", "_bucket").orderBy("_order", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    frame = frame.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return frame.join(ahead, ["_k", "_bucket"]).withColumn("_queued", F.col("_ahead") + F.col("_inside")).drop("_bucket", "_ahead", "_inside")


def cut(passes: DataFrame, budget: int) -> tuple[float, DataFrame]:
    """Where the global order of `passes` (_k, goal, size, ahead: words queued before) comes to `budget` words.

    Returns a virtual time and, per source, the words that still go to it: all words that finish by the time are in the mix,
    and of the words that finish together right after it (they tie), the sources first in order take theirs. The table of
    these is empty unless words tie at the cut.
    """
    def part(time: Column | float) -> Column:
        time = F.lit(time) if isinstance(time, float) else time
        return F.greatest(F.lit(0), F.least(F.col("size"), F.floor(time * F.col("goal")) - F.col("ahead")))

    def between(low: float, high: float) -> DataFrame:
        return passes.where(part(high) > part(low))

    low, done = 0.0, 0
    high = (passes.agg(F.max((F.col("ahead") + F.col("size")) / F.col("goal"))).first()[0] or 0.0) * (1 + 1e-9)
    none = between(low, low).select("_k", F.col("size").alias("_extra"))
    while (high - low) / CELLS > high * 1e-15:
        step = (high - low) / CELLS
        edges = [low + step * i for i in range(CELLS + 1)]

        def cell(words: Column) -> Column:
            return F.floor((words / F.col("goal") - F.lit(low)) / F.lit(step))

        first = F.greatest(F.lit(0), cell(F.col("ahead")) - 1)
        last = F.least(F.lit(CELLS - 1), cell(F.col("ahead") + F.col("size")) + 1)
        dealt = between(low, edges[-1]).select("goal", "size", "ahead", F.explode(F.sequence(first, last)).alias("cell"))
        words = part(F.lit(low) + F.lit(step) * (F.col("cell") + 1)) - part(F.lit(low) + F.lit(step) * F.col("cell"))
        counted = dict(dealt.groupBy("cell").agg(F.sum(words).alias("words")).collect())
        for i in sorted(counted):
            if done + counted[i] >= budget:
                break
            done += counted[i]
        else:
            return edges[-1], none
        low, high = edges[i], edges[i + 1]
        if done + counted[i] == budget:
            return high, none
    tied = between(low, high).groupBy("_k").agg(F.sum(part(high) - part(low)).alias("_words"))
    before = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget - done) - F.coalesce(F.sum("_words").over(before), F.lit(0))
    return low, tied.select("_k", F.greatest(F.lit(0), F.least(F.col("_words"), left)).alias("_extra"))


def mix(docs: DataFrame, carry: list[str] | None = None, budget: int | None = None) -> DataFrame:
    """Every row of `docs` with size, source_size, target, start, finish (virtual times) and taken (words the mix takes).

    `budget` is the words of the mix, by default what the targets add up to. start and finish are those of a document's first
    pass; later ones come one source's size later each. Sorted by finish time. Null text has size 0 and takes nothing; sources
    that share a name up to null are one source; an empty table gives an empty result; texts of any length are counted whole.
    Documents with equal ids follow each other by size and hash of the text, so only equal rows are interchangeable. `carry`
    names the columns of `docs` in the result (all, if not given; to be given where they are few); those named like an output
    are replaced.
    """
    made = ("size", "source_size", "target", "start", "finish", "taken")
    # A key that is never null: rows stay dealt by it from the running sums through the joins.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    carried = Carried(docs if carry is None else docs.select(*carry), made)
    frame = docs.select(
        *carried.inside(), "doc_id", "source", F.size(space_words(whole("text"))).cast("long").alias("size"), key.alias("_k"),
        order_key().alias("_order"), text_key(whole("text")).alias("_tie"))
    # Few columns are stored beside the sizes; a whole table is read, and its words counted, again instead of stored twice.
    if carry is None:
        rows = written(frame.select("source", "size", "_k", "_order", "_tie"), "mix-rows")
    else:
        rows = frame = written(frame, "mix-rows")
    totals = written(rows.groupBy("source", "_k").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), "mix-sizes")
    goal = targets(totals.select("source", "_k", "source_size", "_rows"))
    # Whole up to rounding: a target that is whole but for the last digits counts as whole.
    near = F.round("target")
    goal = written(goal.select("_k", "_rows", "source_size", "target", F.when(F.abs(F.col("target") - near) <= 1e-6, near).otherwise(F.col("target")).alias("goal")), "mix-targets")
    largest, total = goal.agg(F.max("_rows"), F.sum(F.floor("goal"))).first()
    buckets = 64
    while buckets < 65536 and ((largest or 0) > buckets * BUCKET_ROWS or buckets * buckets < (largest or 0)):
        buckets *= 2
    runs = _queued(rows.select("_k", "_order", "_tie", "size"), buckets).where("size > 0").join(goal, "_k")
    runs = written(runs.select("_k", "goal", "size", "source_size", "_queued"), "mix-runs")
    passes = runs.select("_k", "goal", "size", F.explode(F.array(
        *[F.col("_queued") + n * F.col("source_size") for n in range(MAX_REPEATS)])).alias("ahead"))
    time, extra = cut(passes, (total or 0) if budget is None else budget)
    served = written(goal.join(extra, "_k", "left").withColumn(
        "_served", F.floor(F.lit(time) * F.col("goal")) + F.coalesce("_extra", F.lit(0))).drop("_extra", "_rows"), "mix-served")
    frame = _queued(frame, buckets).join(served, "_k")
    queued, own = F.col("_queued"), F.col("source_size")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), F.col("_served") - n * own - queued)) for n in range(MAX_REPEATS)), F.lit(0))
    frame = frame.withColumns({
        "start": queued / F.nullif(F.col("target"), F.lit(0.0)), "finish": (queued + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0)),
        "taken": taken.cast("long")})
    order = [F.col("finish"), F.col("doc_id")]
    return frame.repartitionByRange(*order).sortWithinPartitions(*order).select(*carried.outside(), *made)
