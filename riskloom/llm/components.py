"""Connected components of a link table by alternating large and small stars. All state is in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import written

#: Far beyond the logarithm of any graph's size; reaching it is an error and nothing is returned.
MOST_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them. Edges lead from large (u) to small (v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node of `links` (a, b); nodes without a link are not listed."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    for _ in range(MOST_ROUNDS):
        edges = written(_small(_large(edges)), "stars")
        mark = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if mark == before:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        before = mark
    raise RuntimeError("components did not settle")
