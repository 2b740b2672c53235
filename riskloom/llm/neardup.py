"""Near-duplicates by HyperMinHash: banded compressed registers propose links, full shingle sets confirm them.

Every distinct text is one node, so exact copies never meet each other. A node's sketch has one register per bucket; each
bucket permutes all shingles by its own hash (no bucket is empty, however short the text) and keeps, of the smallest
value, its count of leading zeros and the mantissa bits that follow. Bands of registers are the blocking keys.

Inside a band, members are compared with one leader: the node that meets most others over all its bands, which in a group
of near-copies is close to the text they come from. A group thus costs a star and not all pairs. Links whose estimate
(corrected for registers that agree by chance) is far below the bound are dropped; all others are verified on full sets.

What is left are pairs of members, of which one at least is no link of their leader. Two such sets can only be near if
they differ from the leader in the same shingles: with differences x and y from the leader, |x| + |y| - 2 |x & y| must stay
within a seventh of both sizes, and as x alone exceeds its share, more than 3/7 of y is in x. So the pairs are found by a
prefix-filtered join over the differences, rarest first, with bounds on their lengths, which is exact. Before it, a member lets
go of each key under which no member of another component could be near enough, were all its keys shared: of two large groups
close to each other, whose members hold the same keys, none is left to pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.llm.columns import Carried, text_key, whole
from riskloom.llm.hashing import U64, batches_of_words, mix, seeds, shingles
from riskloom.session import written

SHINGLE, PERCENT = 5, 75
#: Registers and registers per band: a pair at the bound is missed with probability (1 - 0.75^4)^32, about 5 in a million.
REGISTERS, ROWS = 128, 4
#: Bits of mantissa in a register; two different minima agree by chance about once in 2^MANTISSA.
MANTISSA = 10
#: An estimate is refused below this; at similarity 0.75 its deviation is 0.038, so six deviations lie between.
LEAST_ESTIMATE = 0.52
#: Shingles times registers worked on at once.
CELLS = 1 << 19

#: Members let go of keys that lead to no link in rounds, until a round leaves more than this share of them. Links are the same
#: whatever the rounds, only the join after them is smaller.
SETTLED, ROUNDS = 0.9, 6

_BUCKETS = seeds(REGISTERS, 1 << 30) | U64(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of shingle hashes: per bucket, leading zeros and mantissa of the least permuted hash."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=U64)
    step = max(1, CELLS // REGISTERS)
    for at in range(0, len(hashes), step):
        part = hashes[at: at + step, None] * _BUCKETS[None, :]
        part ^= part >> U64(32)
        part *= U64(0x9E3779B97F4A7C15)
        np.minimum(least, part.min(axis=0), out=least)
    # A double's exponent gives the leading zeros; below 2^53 nothing is rounded up.
    zeros = np.minimum(64 - np.frexp((least >> U64(11)).astype(np.float64))[1] - 11, 53)
    mantissa = (least << (zeros + 1).astype(U64)) >> U64(64 - MANTISSA)
    return ((zeros.astype(U64) << U64(MANTISSA)) | mantissa).astype(">u2")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
        sizes, sketches = [], []
        for _, words, offsets in batches_of_words(texts):
            for a, b in zip(offsets[:-1], offsets[1:]):
                found = np.unique(shingles(words[a:b], SHINGLE))
                sizes.append(len(found))
                sketches.append(registers(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("node"), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
            ["doc_id", "node", "n_shingles", "sketch"])


def _agreeing(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose collision-corrected estimate is not far below the bound."""
    chance = 2.0 ** -MANTISSA
    for batch in pairs:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=">u2").reshape(-1, REGISTERS) for c in ("sa", "sb"))
        estimate = ((left == right).mean(axis=1) - chance) / (1 - chance)
        yield batch.select(["a", "b"]).filter(pa.array(estimate >= LEAST_ESTIMATE))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The full shingle sets of each pair; rows come in order of a leader, whose set is made once a batch."""
    sets: dict[bytes, np.ndarray] = {}
    sides = [(batch.column(c).to_pylist(), batch.column("t" + c)) for c in ("a", "b")]
    for i in range(batch.num_rows):
        both = []
        for nodes, texts in sides:
            if nodes[i] not in sets:
                _, words, _ = next(batches_of_words([texts[i].as_py().encode()]))
                sets[nodes[i]] = np.unique(shingles(words, SHINGLE))
            both.append(sets[nodes[i]])
        yield both[0], both[1]


def _confirmed(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that share enough of their full shingle sets."""
    for batch in pairs:
        keep = []
        for a, b in _sets(batch):
            shared = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * shared >= PERCENT * (len(a) + len(b) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _differences(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles in one set of a pair only, each mixed with the leader, and both sizes."""
    for batch in pairs:
        rows = [(np.setxor1d(a, b, assume_unique=True), len(a), len(b)) for a, b in _sets(batch)]
        leaders = [U64(int.from_bytes(x[:8], "little")) for x in batch.column("a").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array([n for _, n, _ in rows], pa.int64()), pa.array([n for _, _, n in rows], pa.int64()),
             pa.array([mix(d ^ leader).view(np.int64) for (d, _, _), leader in zip(rows, leaders)], pa.list_(pa.int64()))],
            ["a", "b", "na", "nb", "diff"])


class Pairs:
    """Pairs of nodes with what is known of the nodes: their sketches, and their texts on demand."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs, nodes

    def texts(self, pairs: DataFrame) -> DataFrame:
        """a, b, ta, tb. One row of each node gives its text; only nodes in a pair are fetched."""
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = wanted.join(self.nodes.select("node", "rep"), "node").select(F.col("node").alias("_n"), F.col("rep").alias("_r"))
        texts = self.docs.join(wanted, (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_r")), "left_semi")
        texts = written(texts.select("node", "text"), "near-texts")
        return pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(
            texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """a, b of the distinct `pairs` that are links."""
        sketch = self.nodes.select("node", "sketch")
        near = pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(
            sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b").select("a", "b", "sa", "sb")
        near = written(near.mapInArrow(_agreeing, "a binary, b binary"), "near-pairs")
        return written(self.texts(near).mapInArrow(_confirmed, "a binary, b binary").distinct(), "near-links")

    def member_prefixes(self, stars: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Keys by which members of one star (a: leader, b: member) meet that may be links and lie in different components.

        The left side holds members apart from their leader, the right side all. One member stands for all of its component
        with the same keys: the one of most slack (size less seven times its difference), which links wherever any does.
        """
        named = stars.join(found.select(F.col("node").alias("b"), "root"), "b", "left").select("a", "b", F.coalesce("root", "b").alias("root"))
        open_stars = named.groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("a")
        rows = written(self.texts(stars.join(open_stars, "a", "left_semi")).mapInArrow(
            _differences, "a binary, b binary, na long, nb long, diff array<long>"), "near-differences")
        size = F.size("diff").cast("long")
        fixed = ("a", "b", "root", "na", "s", "slack")
        held = rows.join(named, ["a", "b"]).select(
            "a", "b", "root", "na", size.alias("s"), (F.col("nb") - 7 * size).alias("slack"), size.alias("u"), F.explode("diff").alias("key"))
        before = None
        for _ in range(ROUNDS):
            held = written(held, "near-held")
            left = held.count()
            if before is not None and left > SETTLED * before:
                break
            before = left
            best = held.groupBy("key", "root").agg(F.max("slack").alias("best"), F.count("*").alias("n"))
            # The two components of most slack under a key; ranks beyond are cut before the shuffle.
            rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("best"), "root"))
            first = best.withColumn("rank", rank).where("rank <= 2").groupBy("key").agg(
                F.max(F.when(F.col("rank") == 1, F.col("root"))).alias("root1"), F.max(F.when(F.col("rank") == 1, F.col("best"))).alias("best1"),
                F.max(F.when(F.col("rank") == 2, F.col("best"))).alias("best2"))
            keys = written(first.where("best2 is not null").join(best.groupBy("key").agg(F.sum("n").alias("df")), "key"), "near-common")
            # Null only where no other component has the key; a key stays where some holder may be near enough.
            other = F.when(F.col("root") == F.col("root1"), F.col("best2")).otherwise(F.col("best1"))
            ordered = held.join(keys, "key").where(14 * F.col("u") + F.col("slack") + other >= 0).groupBy(*fixed).agg(
                F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
            ordered = written(ordered, "near-ordered")
            held = ordered.select(*fixed, F.size("keys").cast("long").alias("u"), F.explode("keys.key").alias("key"))
        stand = ordered.groupBy("a", "root", "na", "keys").agg(F.max(F.struct("slack", "s", "b")).alias("m"))
        over = -(F.col("m.slack") + F.col("na"))
        member = written(stand.select(
            "m.b", "root", "keys", "m.slack", F.size("keys").alias("u"), (over > 0).alias("apart"),
            # Shared by any pair, at least: of one that is apart from the leader, and of its partner.
            F.greatest(F.lit(1), F.ceil(over / 14)).alias("least_apart"), (F.floor(3 * F.col("m.s") / 7) + 1).alias("least")), "near-members")

        def prefix(frame: DataFrame, least: str, end: str) -> DataFrame:
            length = (F.col("u") - F.col(least) + 1).cast("int")
            return frame.where(length > 0).select(F.explode(F.slice("keys.key", F.lit(1), length)).alias("key"), *[F.col(c).alias(c + end) for c in ("b", "slack", "root", "u")])

        return prefix(member.where("apart"), "least_apart", "1"), prefix(member, "least", "2")

    def among_members(self, stars: DataFrame, found: DataFrame) -> DataFrame:
        """Distinct pairs of members of one star that may be links and lie in different components."""
        left, right = self.member_prefixes(stars, found)
        fits = 14 * F.least("u1", "u2") + F.col("slack1") + F.col("slack2") >= 0
        met = left.join(right, "key").where((F.col("root1") != F.col("root2")) & fits)
        return met.select(F.least("b1", "b2").alias("a"), F.greatest("b1", "b2").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_shingles, component_id, kept: one row per row of `docs`.

    Documents link when their sets share 75 % of their union. component_id is the smallest doc_id of the linked group,
    null ids aside; kept marks its row. Null and wordless texts have an empty set, link with nothing and are kept. Rows that
    repeat an id with other texts are told apart by text; equal rows stay equal, so both are kept or neither.
    """
    frame = docs.select("doc_id", whole("text").alias("text")).withColumn("node", F.unhex(text_key(F.col("text"))))
    rows = written(frame.mapInArrow(_sketches, "doc_id long, node binary, n_shingles long, sketch binary"), "sketches")
    nodes = written(rows.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.max("sketch").alias("sketch")), "near-nodes")
    bands = REGISTERS // ROWS
    key = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(
        i, F.substring(F.col("sketch"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    keyed = nodes.select("node", F.explode(key).alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(shared, "band"), "near-bands")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = members.join(weight, "node").select("band", "node", "weight")
    leaders = weighed.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("leader")).select("band", F.col("leader.node").alias("a"))
    stars = written(members.join(leaders, "band").where("node != a").select("a", F.col("node").alias("b")).distinct(), "near-stars")

    pairs = Pairs(frame, nodes)
    links = pairs.confirm(stars)
    found = components(links)
    links = links.unionByName(pairs.confirm(pairs.among_members(stars, found)))
    found = components(links)
    named = nodes.select("node", "rep").join(found, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    # Joined back by root, then by node: both sides are rows of nodes, and large groups are split as skewed partitions.
    named = written(named.join(smallest, "root").select("node", "component_id"), "near-named")
    out = rows.select("doc_id", "node", "n_shingles").join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "node", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `classes` keeps, with all their columns; of equal rows all stay that are kept."""
    gone = written(classes(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone"), "node").distinct(), "near-gone")
    carried = Carried(docs)
    frame = docs.select(*carried.inside(), "doc_id", F.unhex(text_key(whole("text"))).alias("own"))
    return frame.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("own") == F.col("node")), "left_anti").select(*carried.outside())
