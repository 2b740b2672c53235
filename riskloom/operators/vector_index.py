"""A metric index over vectors: which blocks can hold neighbours is known from distances to a few pivots.

Vectors are scaled to length 1, where similarity and distance go together: cos = 1 - d²/2. Each vector lies in the cell of its
nearest pivot; a cell is cut into blocks along the distance to its pivot. A block knows the range of its vectors' distances to
every pivot, and by the triangle inequality two blocks are at least as far apart as the widest gap between their ranges. Blocks are
dealt into a fixed number of tiles; a task gets two tiles, holds the blocks of one and passes those of the other by. Pairs of
tiles that cannot reach the wanted similarity are never brought together, pairs of blocks that cannot are not compared.

For the k nearest, a query's wanted similarity is its k-th best among a bounded sample of the vectors; a block asks for the
least of its queries. Bounds leave a margin for rounding, so results are those of comparing all pairs.

Equal vectors are one entry: a class is compared once, and its k smallest ids stand in for it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import written
from riskloom.sources.reference import literal_table

DIGITS = 6
#: Similarities closer than this may trade places by rounding.
MARGIN = 2e-6
#: Pivots at most, and vectors in the bounded sample that pivots and wanted similarities come from.
PIVOTS, SAMPLE = 48, 2048
#: Tiles of blocks a side is dealt into, and rows of a block compared at a time.
TILES, STRIPE = 16, 1024
#: Rows of a batch that a task gives back: a stripe of copies finds all pairs at once.
GIVEN = 1 << 18
_NONE = -2.0


def unit_rows(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def class_key(vector: str) -> Column:
    return F.sha2(F.concat_ws(",", F.col(vector).cast("array<string>")), 256)


def sampled(vectors: DataFrame, size: int = SAMPLE) -> np.ndarray:
    """Unit rows of about `size` different vectors, chosen by hash."""
    share = min(1.0, 2 * size / max(1, vectors.count()))
    order = F.xxhash64(F.col("vector").cast("array<string>"))
    few = vectors.where(F.pmod(order, F.lit(1 << 40)) < int(share * (1 << 40))).select(order.alias("o"), "vector").orderBy("o").limit(size).collect()
    return unit_rows([r["vector"] for r in few]) if few else np.zeros((0, 0))


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each as far as can be from those before."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 1e-12:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((unit * unit).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * unit @ pivots.T, 0))


def _placed(pivots: np.ndarray, sample: np.ndarray | None, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(batch.column("vector").to_pylist())
            away = _distances(unit, pivots)
            cell = away.argmin(axis=1)
            floor = np.full(len(unit), least)
            if sample is not None and len(sample) >= k:
                sims = unit @ sample.T
                floor = np.maximum(floor, np.partition(sims, len(sample) - k, axis=1)[:, len(sample) - k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]), pa.array(floor)],
                ["id", "unit", "cell", "own", "floor"])
    return run


def _cut(pivots: np.ndarray, block: int):
    dims = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
            starts = [a for lo, hi in zip(edges[:-1], edges[1:]) for a in range(lo, hi, block)]
            out = {n: [] for n in ("block", "cell", "ids", "data", "lo", "hi", "floor")}
            for a, b in zip(starts, [*starts[1:], len(cells)]):
                data = b"".join(batch.column("unit").slice(a, b - a).to_pylist())
                away = _distances(np.frombuffer(data).reshape(-1, dims), pivots)
                out["block"].append(number)
                out["cell"].append(int(cells[a]))
                out["ids"].append(batch.column("id").slice(a, b - a).to_pylist())
                out["data"].append(data)
                out["lo"].append(away.min(axis=0).tolist())
                out["hi"].append(away.max(axis=0).tolist())
                out["floor"].append(float(batch.column("floor").slice(a, b - a).to_numpy().min()))
                number += 1
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("block", pa.int64()), ("cell", pa.int32()), ("ids", pa.list_(pa.int64())), ("data", pa.binary()),
                ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("floor", pa.float64())]))
    return run


def blocks(vectors: DataFrame, pivots: np.ndarray, block: int, least: float = _NONE, k: int = 0, sample: np.ndarray | None = None) -> DataFrame:
    """Blocks of at most `block` vectors of one cell: block, cell, ids, data, lo, hi (distances to each pivot), floor. Written once."""
    placed = vectors.select("id", "vector").mapInArrow(_placed(pivots, sample, k, least), "id long, unit binary, cell int, own double, floor double")
    # Vectors of one place (a dense cell) are dealt to several tasks by their id.
    laid = placed.withColumn("salt", F.xxhash64("id")).repartitionByRange(TILES, "cell", "own", "salt").sortWithinPartitions("cell", "own", "salt")
    cut = laid.select("id", "unit", "cell", "floor").mapInArrow(
        _cut(pivots, block), "block long, cell int, ids array<long>, data binary, lo array<double>, hi array<double>, floor double")
    return written(cut, "vector-blocks")


class Pairs:
    """Pairs of blocks that can reach what the first one asks for: how many they are, and how many there are in all.

    Counted when asked for, by (cell and) block bounds; the comparison itself tests the same bounds where the blocks meet.
    """

    def __init__(self, left: DataFrame, right: DataFrame, one_way: bool = False):
        self.left, self.right, self.one_way = left, right, one_way

    @cached_property
    def compared(self) -> int:
        a = self.left.select(F.col("block").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), "floor")
        b = self.right.select(F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        met = a.join(b, F.col("a") <= F.col("b")) if self.one_way else a.crossJoin(b)
        return met.where(_reach("lo_a", "hi_a", "lo_b", "hi_b") + MARGIN >= F.col("floor")).count()

    @cached_property
    def possible(self) -> int:
        n = self.left.count()
        return n * (n + 1) // 2 if self.one_way else n * self.right.count()


def _reach(lo_a, hi_a, lo_b, hi_b) -> Column:
    """The largest similarity that two blocks can reach."""
    gap = F.array_max(F.zip_with(F.zip_with(lo_a, hi_b, lambda x, y: x - y), F.zip_with(lo_b, hi_a, lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    gap = F.greatest(gap, F.lit(0.0))
    return 1 - gap * gap / 2


def _reaches(lo_a, hi_a, lo_b, hi_b, floor: float) -> bool:
    gap = max(0.0, float(np.maximum(lo_a - hi_b, lo_b - hi_a).max()))
    return 1 - gap * gap / 2 + MARGIN >= floor


def _tiled(side: DataFrame) -> DataFrame:
    """Blocks with the tile they belong to: runs of the partitions they were cut in, TILES at most."""
    parts = (side.agg(F.max(F.shiftright("block", 32))).first()[0] or 0) + 1
    return side.withColumn("tile", F.floor(F.shiftright("block", 32) * min(TILES, parts) / parts).cast("int"))


def _met(left: DataFrame, right: DataFrame, n_pivots: int, one_way: bool) -> DataFrame:
    """Rows (a, b, side, block, ids, data, lo, hi, floor) of each pair of tiles that can reach, dealt by pair, the left side first.

    A block travels once per tile of the other side and not once per block, so what is shuffled grows with the vectors.
    """
    left, right = _tiled(left), _tiled(right)

    def bounds(side: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
        # A row a tile.
        rows = side.groupBy("tile").agg(
            F.min("floor").alias("floor"), F.array(*[F.min(F.col("lo")[i]) for i in range(n_pivots)]).alias("lo"),
            F.array(*[F.max(F.col("hi")[i]) for i in range(n_pivots)]).alias("hi")).collect()
        return {r["tile"]: (np.array(r["lo"]), np.array(r["hi"]), r["floor"]) for r in rows}

    of_a, of_b = bounds(left), bounds(right)
    able = [(a, b) for a, (lo_a, hi_a, floor) in of_a.items() for b, (lo_b, hi_b, _) in of_b.items()
            if (not one_way or a <= b) and _reaches(lo_a, hi_a, lo_b, hi_b, floor)]
    near = F.broadcast(literal_table(left.sparkSession, able, "a int, b int"))

    def sent(side: DataFrame, by: str, number: int) -> DataFrame:
        rows = side.withColumnRenamed("tile", by).join(near, by)
        return rows.select("a", "b", F.lit(number).alias("side"), "block", "ids", "data", "lo", "hi", "floor")

    both = sent(left, "a", 0).unionByName(sent(right, "b", 1))
    return both.repartition(max(1, len(able)), "a", "b").sortWithinPartitions("a", "b", "side", "block")


class _Block:
    def __init__(self, batch: pa.RecordBatch, i: int, dims: int):
        def floats(name: str) -> np.ndarray:
            return np.asarray(batch.column(name)[i].values)

        self.number, self.floor = batch.column("block")[i].as_py(), batch.column("floor")[i].as_py()
        self.ids, self.lo, self.hi = np.array(floats("ids")), np.array(floats("lo")), np.array(floats("hi"))
        self.unit = np.frombuffer(batch.column("data")[i].as_py()).reshape(-1, dims)


class _All:
    """Every pair from `least` on, smaller id first if `one_way`."""

    def __init__(self, least: float, one_way: bool):
        self.least, self.one_way = least, one_way

    def floor(self, a: _Block) -> float:
        return a.floor

    def done(self, a: _Block, at: int) -> bool:
        return False

    def take(self, a: _Block, b: _Block, at: int, sims: np.ndarray):
        rows, cols = np.nonzero(np.triu(sims >= self.least, at + 1) if self.one_way and a.number == b.number else sims >= self.least)
        if not len(rows):
            return None
        q, v = a.ids[at + rows], b.ids[cols]
        return (np.minimum(q, v), np.maximum(q, v), sims[rows, cols]) if self.one_way else (q, v, sims[rows, cols])

    def rest(self):
        return iter(())


class _Any:
    """One vector from `least` on for every row of the left blocks that has any. A row that has one is settled."""

    def __init__(self, least: float):
        self.least = least
        self.open: dict[int, np.ndarray] = {}

    def floor(self, a: _Block) -> float:
        return a.floor if a.number not in self.open or self.open[a.number].any() else np.inf

    def done(self, a: _Block, at: int) -> bool:
        return a.number in self.open and not self.open[a.number][at:at + STRIPE].any()

    def take(self, a: _Block, b: _Block, at: int, sims: np.ndarray):
        still = self.open.setdefault(a.number, np.ones(len(a.ids), dtype=bool))[at:at + STRIPE]
        near = sims.argmax(axis=1)
        values = sims[np.arange(len(sims)), near]
        rows = np.flatnonzero(still & (values >= self.least))
        if not len(rows):
            return None
        still[rows] = False
        return a.ids[at + rows], b.ids[near[rows]], values[rows]

    def rest(self):
        return iter(())


class _Best:
    """The k best from `least` on of every row of the left blocks, equal similarities by id."""

    def __init__(self, k: int, least: float):
        self.k, self.least = k, least
        self.found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.kth: dict[int, np.ndarray] = {}
        self.ids: dict[int, np.ndarray] = {}

    def floor(self, a: _Block) -> float:
        return max(a.floor, float(self.kth[a.number].min())) if a.number in self.kth else a.floor

    def done(self, a: _Block, at: int) -> bool:
        return False

    def take(self, a: _Block, b: _Block, at: int, sims: np.ndarray):
        if a.number not in self.kth:
            self.kth[a.number], self.ids[a.number] = np.full(len(a.ids), self.least), a.ids
        kth = self.kth[a.number][at:at + len(sims)]
        keep = sims >= kth[:, None]
        if sims.shape[1] > self.k and np.count_nonzero(keep) > 4 * self.k * len(sims):
            keep &= sims >= np.partition(sims, sims.shape[1] - self.k, axis=1)[:, sims.shape[1] - self.k][:, None]
        rows, cols = np.nonzero(keep)
        if len(rows):
            values, ids = sims[rows, cols], b.ids[cols]
            if (a.number, at) in self.found:
                rows, ids, values = (np.concatenate(c) for c in zip(self.found[a.number, at], (rows, ids, values)))
            order = np.lexsort((ids, -values, rows))
            rows, ids, values = rows[order], ids[order], values[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
            last, near = place == self.k - 1, place < self.k
            kth[rows[last]] = values[last]
            self.found[a.number, at] = rows[near], ids[near], values[near]

    def rest(self):
        for (number, at), (rows, ids, values) in self.found.items():
            yield self.ids[number][at + rows], ids, values


def _compared(dims: int, one_way: bool, fresh):
    """Task function: tiles of the left held, blocks of the right passed by. fresh: a new collector for each pair of tiles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, kept = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                here = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                if here != pair:
                    if kept is not None:
                        yield from _found(kept.rest())
                    pair, held, kept = here, [], fresh()
                block = _Block(batch, i, dims)
                if batch.column("side")[i].as_py() == 0:
                    held.append(block)
                    continue
                for a in held:
                    if (one_way and a.number > block.number) or not _reaches(a.lo, a.hi, block.lo, block.hi, kept.floor(a)):
                        continue
                    for at in range(0, len(a.ids), STRIPE):
                        if kept.done(a, at):
                            continue
                        sims = a.unit[at:at + STRIPE] @ block.unit.T
                        np.round(sims, DIGITS, out=sims)
                        sims += 0.0
                        if (found := kept.take(a, block, at, sims)) is not None:
                            yield from _found([found])
        if kept is not None:
            yield from _found(kept.rest())
    return run


def _found(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for cols in parts:
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "similarity"])
        for at in range(0, batch.num_rows, GIVEN):
            yield batch.slice(at, GIVEN)


_FOUND = "query_id long, vec_id long, similarity double"


def edges_at_least(vectors: DataFrame, least: float, block: int) -> tuple[DataFrame, Pairs | None]:
    """(query_id < vec_id, similarity) of all pairs of different rows of `vectors` (id, vector) from `least` on, and what was compared."""
    sample = sampled(vectors)
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], _FOUND), None
    pivots = pivots_of(sample, PIVOTS)
    laid = blocks(vectors, pivots, block, least)
    met = _met(laid, laid, len(pivots), one_way=True)
    return met.mapInArrow(_compared(pivots.shape[1], True, lambda: _All(least, True)), _FOUND), Pairs(laid, laid, one_way=True)


def all_at_least(queries: DataFrame, vectors: DataFrame, k: int, least: float, skip_self: bool, block: int) -> tuple[DataFrame, Pairs | None]:
    """(query_id, vec_id, similarity): all pairs from `least` on, and what was compared. k is not looked at."""
    sample = sampled(vectors)
    if not len(sample):
        return queries.sparkSession.createDataFrame([], _FOUND), None
    pivots = pivots_of(sample, PIVOTS)
    left, right = blocks(queries, pivots, block, least), blocks(vectors, pivots, block)
    met = _met(left, right, len(pivots), one_way=False)
    found = met.mapInArrow(_compared(pivots.shape[1], False, lambda: _All(least, False)), _FOUND)
    return found.where("query_id <> vec_id") if skip_self else found, Pairs(left, right)


def one_at_least(queries: DataFrame, vectors: DataFrame, least: float, block: int) -> DataFrame:
    """(query_id, vec_id, similarity): one vector from `least` on per row of `queries` that has any; once per pair of tiles at most.

    So many rows as there are queries, times a constant, however many pairs there are.
    """
    sample = sampled(vectors)
    if not len(sample):
        return queries.sparkSession.createDataFrame([], _FOUND)
    pivots = pivots_of(sample, PIVOTS)
    met = _met(blocks(queries, pivots, block, least), blocks(vectors, pivots, block), len(pivots), one_way=False)
    return met.mapInArrow(_compared(pivots.shape[1], False, lambda: _Any(least)), _FOUND)


def k_nearest(queries: DataFrame, vectors: DataFrame, k: int, least: float | None, skip_self: bool, block: int) -> tuple[DataFrame, Pairs | None]:
    """(query_id, vec_id, similarity): the k best of `vectors` (id, vector) per row of `queries`, equal similarities by id, and
    what was compared. skip_self: a vector of the query's own id is left out."""
    wanted = k + 1 if skip_self else k
    sample = sampled(vectors)
    if not len(sample):
        return queries.sparkSession.createDataFrame([], _FOUND), None
    pivots = pivots_of(sample, PIVOTS)

    def classes(rows: DataFrame) -> DataFrame:
        return written(rows.select("id", class_key("vector").alias("key")), "vector-classes")

    def heads(rows: DataFrame, marked: DataFrame) -> DataFrame:
        return rows.join(marked.groupBy("key").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")

    own, asked = classes(vectors), classes(queries)
    # The `wanted` smallest ids of each class.
    order = Window.partitionBy("key").orderBy("id")
    members = own.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= wanted).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    members = members.select(F.col("ids")[0].alias("vec_id"), "ids")
    right = blocks(heads(vectors, own), pivots, block)
    left = blocks(heads(queries, asked), pivots, block, _NONE if least is None else least, wanted, sample)
    floor = _NONE if least is None else least
    found = _met(left, right, len(pivots), one_way=False).mapInArrow(_compared(pivots.shape[1], False, lambda: _Best(wanted, floor)), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    top = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= wanted).drop("_r")
    # At most wanted * wanted candidates a class of queries.
    each = F.transform("ids", lambda i: F.struct((-F.col("similarity")).alias("s"), i.alias("id")))
    offers = top.join(members, "vec_id").groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list(each))).alias("offers"))
    named = asked.join(asked.groupBy("key").agg(F.min("id").alias("query_id")), "key").select("id", "query_id")
    per_row = named.join(offers, "query_id")
    mine = F.filter("offers", lambda o: o["id"] != F.col("id")) if skip_self else F.col("offers")
    out = per_row.select(F.col("id").alias("query_id"), F.explode(F.slice(mine, 1, k)).alias("o"))
    return out.select("query_id", F.col("o.id").alias("vec_id"), (-F.col("o.s")).alias("similarity")), Pairs(left, right)
