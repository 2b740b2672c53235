"""Centroid clustering over zone maps along a space-filling curve.

Vectors are ordered along a Hilbert curve through the main directions of a bounded sample and cut into blocks, each with the
smallest and largest value of every component. In a round, a block's box bounds its distance to each centroid: a centroid
whose least distance exceeds another one's greatest, or that is farther than a chosen centroid at every corner of the box,
cannot be nearest to any vector in it. The rest are its candidates, and the block's vectors are compared with them exactly.

All arithmetic is on whole numbers. The curve decides only which vectors share a block, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import written

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors in a block; axes of the curve and bits of each (together under 63); vectors that the axes are fitted on.
BLOCK, AXES, BITS, SAMPLE = 64, 8, 7, 10_000
#: Components are held within this bound, so that every squared distance is a 64-bit number.
BOUND = 1 << 27
#: Below this bound sums of products are exact in doubles.
_EXACT = 1 << 22


def kept(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: the whole-number vectors of the rows with exactly DIMS components, none null or non-finite."""
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    held = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), x.cast("double") * SCALE))).cast("int"))
    return embeddings.where((F.size("embedding") == DIMS) & sound).select("vec_id", held.alias("v"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `cells` (n, axes), values below 2 ** bits: Skilling's transform, all rows at once."""
    x = cells.T.astype(np.int64).copy()
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = high
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(len(x)):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, DIMS)


def _placed(vectors: DataFrame) -> DataFrame:
    """vec_id, v, h: each vector with its place on the curve."""
    share = min(1.0, 2 * SAMPLE / max(1, vectors.count()))
    order = F.xxhash64("vec_id", "v")
    some = vectors.where(F.pmod(order, F.lit(1 << 40)) < int(share * (1 << 40))).select("v").distinct().orderBy(F.xxhash64("v")).limit(SAMPLE)
    sample = np.array([r.v for r in some.collect()], dtype=np.float64).reshape(-1, DIMS)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(DIMS)
    _, axes = np.linalg.eigh((sample - mean).T @ (sample - mean))
    axes = axes[:, ::-1][:, :AXES]
    # Cells hold about the same number of sampled vectors each.
    steps = np.arange(1, 1 << BITS) / (1 << BITS)
    edges = np.quantile((sample - mean) @ axes, steps, axis=0) if len(sample) else np.zeros((len(steps), AXES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (_rows(batch.column("v")) - mean) @ axes
            cells = np.stack([np.searchsorted(edges[:, i], at[:, i]) for i in range(AXES)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, BITS), pa.int64())], ["vec_id", "v", "h"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<int>, h long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = np.ascontiguousarray(_rows(batch.column("v")), dtype="<i4")
        ids, starts = batch.column("vec_id"), range(0, len(every), BLOCK)
        parts = [every[a:a + BLOCK] for a in starts]
        cuts = pa.array([*starts, len(every)], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(cuts, ids), *[pa.array([f(p).tobytes() for p in parts], pa.binary()) for f in (np.asarray, lambda p: p.min(axis=0), lambda p: p.max(axis=0))]],
            ["ids", "data", "lo", "hi"])


def blocks(vectors: DataFrame) -> DataFrame:
    """ids, data, lo, hi: blocks of vectors that are neighbours on the curve, with their boxes. Written once.

    A place on the curve that holds many vectors (copies) is dealt to several tasks.
    """
    placed = _placed(vectors).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    laid = placed.repartitionByRange("h", "salt").sortWithinPartitions("h", "salt").select("vec_id", "v")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return written(laid.mapInArrow(_cut, f"ids array<{kind}>, data binary, lo binary, hi binary"), "curve-blocks")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers, ascending, of the centroids that may be nearest to a vector within the box (equal distance included)."""
    gap = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
    far = np.maximum(np.abs(centroids - lo), np.abs(centroids - hi))
    least, most = (gap * gap).sum(axis=1), (far * far).sum(axis=1)
    left = np.flatnonzero(least <= most.min())
    # Against the centroid nearest to the middle of the box: the difference of squared distances is linear in the vector.
    middle = (lo + hi) // 2
    chosen = centroids[left[((centroids[left] - middle) ** 2).sum(axis=1).argmin()]]
    way = centroids[left] - chosen
    best = ((centroids[left] ** 2).sum(axis=1) - (chosen ** 2).sum()) - 2 * np.maximum(way * lo, way * hi).sum(axis=1)
    return left[best <= 0]


def nearest(block: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (the smaller of equals) and exact squared distance of the nearest centroid of each row."""
    if max(np.abs(block).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        x, c = block.astype(np.float64), centroids.astype(np.float64)
        d = ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None]) - 2 * (x @ c.T)
        d = d.astype(np.int64)
    else:
        d = np.stack([((block - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(d)), at]


def _each(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per block: vectors, cluster and distance of each, and how many centroids it was compared with."""
    def whole(name):
        return [np.frombuffer(x.as_py(), dtype="<i4").astype(np.int64) for x in batch.column(name)]

    for data, lo, hi in zip(whole("data"), whole("lo"), whole("hi")):
        block, able = data.reshape(-1, DIMS), candidates(lo, hi, centroids)
        at, distance = nearest(block, centroids[able])
        yield block, able[at], distance, len(able)


def _sums(centroids: np.ndarray):
    """Per task and cluster: component sums, under part DIMS the number of vectors, under DIMS + 1 the comparisons spared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), DIMS + 2), dtype=np.int64)
        for batch in batches:
            for block, cluster, _, tried in _each(batch, centroids):
                for k in np.unique(cluster):
                    mine = block[cluster == k]
                    total[k, :DIMS] += mine.sum(axis=0)
                    total[k, DIMS] += len(mine)
                total[0, DIMS + 1] += len(block) * (len(centroids) - tried)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, DIMS + 2).astype(np.int32)), pa.array(np.tile(np.arange(DIMS + 2), len(some)).astype(np.int32)), pa.array(total[some].ravel())],
            ["cluster", "part", "total"])
    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = list(_each(batch, centroids))
            if done:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").flatten(), pa.array(np.concatenate([c for _, c, _, _ in done]).astype(np.int32)), pa.array(np.concatenate([d for _, _, d, _ in done]))],
                    ["vec_id", "cluster", "distance"])
    return run


def step(laid: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after one round, and how many comparisons the boxes spared. Empty clusters stay."""
    moved, spared = centroids.copy(), 0
    # CLUSTERS x (DIMS + 2) numbers, whatever the input.
    rows = laid.mapInArrow(_sums(centroids), "cluster int, part int, total long").groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect()
    total = {(r["cluster"], r["part"]): r["total"] for r in rows}
    for k in {k for k, _ in total}:
        spared += total[k, DIMS + 1]
        if total[k, DIMS]:
            moved[k] = [total[k, i] // total[k, DIMS] for i in range(DIMS)]
    return moved, spared


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept row of `embeddings` (vec_id, embedding).

    The first centroids are the `clusters` kept vectors of smallest hash of their id (fewer if there are fewer vectors), equal
    ids by vector; null ids come last. Repeated rows are vectors of their own. Components beyond BOUND count as BOUND. A sum of
    distances over 64 bits is null. No kept vector gives no rows. Other columns are ignored.
    """
    spark, vectors = embeddings.sparkSession, kept(embeddings)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    by_hash: list[Column] = [F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), F.col("v").asc()]
    first = vectors.orderBy(*by_hash).limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in first], dtype=np.int64)
    laid = blocks(vectors)
    for _ in range(rounds):
        centroids, _ = step(laid, centroids)
    final = written(laid.mapInArrow(_assigned(centroids), f"vec_id {kind}, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    inertia = None if None in sums.values() or sum(sums.values()) >= 1 << 63 else sum(sums.values())
    named = [(k, s, inertia, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in sums.items()]
    told = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
