"""Ranked lexical search by bag deduplication.

Documents are cut down to the items' vocabulary. Those with the same term counts and the same length factor m form a class:
they score alike for every item. Classes are keyed by a 64-bit hash that is verified (two different bags under one key give
the hash another seed), scored once, and only the members of winning classes are expanded, by ascending doc_id. A class
after 50 others by (score, smallest doc_id) cannot hold one of the 50 best documents: each class before it has one.

Items are worked off in blocks of bounded size, so a large item table costs more passes and no more memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.columns import ascii_lower, whole
from riskloom.session import written

TOP = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bounds of one block of items: distinct (item, term) pairs, and items.
BLOCK_PAIRS, BLOCK_ITEMS = 200_000, 2_000
#: Bytes of a text worked on at once, and (class, item) sums made at once.
PIECE, SUMS = 1 << 20, 1 << 21

#: A-Z to a-z, every other ASCII character outside letters and digits to a space; bytes beyond ASCII stay.
_FORM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: Column) -> Column:
    """Terms of a text in order, with repeats."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in its matching form, in parts cut between terms."""
    data, at = data.translate(_FORM), 0
    while len(data) - at > PIECE:
        cut = data.rfind(b" ", at, at + PIECE)
        cut = data.find(b" ", at + PIECE) if cut <= at else cut
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def _counter(number: dict[bytes, int]):
    """doc_id, n (all terms), terms and tfs (numbers and counts of the vocabulary's terms, by number)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, tfs, ends = [], [], [], [0]
            for value in batch.column("t"):
                n, bag = 0, Counter()
                for piece in _pieces(value.as_py()):
                    words = piece.split()
                    n += len(words)
                    bag.update(filter(number.__contains__, words))
                found = sorted((number[w], c) for w, c in bag.items())
                sizes.append(n)
                ids += [i for i, _ in found]
                tfs += [c for _, c in found]
                ends.append(len(ids))
            cuts = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(cuts, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])
    return run


def _scorer(weight: np.ndarray, starts: np.ndarray, items: np.ndarray, n_items: int, top: int):
    """Per task, the `top` classes of each item by (score, smallest doc_id). The items of term t: items[starts[t]:starts[t + 1]]."""
    fan = np.diff(starts)

    def best(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows["h"], rows["first"], rows["bare"], -rows["score"], rows["item"]))]
        first = np.searchsorted(rows["item"], rows["item"], side="left")
        return rows[np.arange(len(rows)) - first < top]

    kind = np.dtype([("item", "i8"), ("score", "i8"), ("bare", "?"), ("first", "i8"), ("h", "i8"), ("m", "i8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, floor = np.zeros(0, kind), np.zeros(n_items, np.int64)
        for batch in batches:
            lengths = batch.column("terms").value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(lengths)])
            t = batch.column("terms").flatten().to_numpy()
            tf = batch.column("tfs").flatten().to_numpy()
            m = batch.column("m").to_numpy()
            first, h = batch.column("first"), batch.column("h").to_numpy()
            bare, first = np.array(first.is_null()), first.fill_null(0).to_numpy()
            row = np.repeat(np.arange(len(m)), lengths)
            part = weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
            # Slices of classes whose sums and postings stay in bounds; one class is a slice at least.
            load = np.cumsum(np.concatenate([[0], np.add.reduceat(np.append(fan[t], 0), ends[:-1])])) + n_items * np.arange(len(m) + 1)
            at = 0
            while at < len(m):
                to = max(at + 1, int(np.searchsorted(load, load[at] + SUMS, side="right")) - 1)
                a, b = ends[at], ends[to]
                reps = fan[t[a:b]]
                where = np.repeat(starts[t[a:b]] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
                scores = np.zeros((to - at) * n_items, np.int64)
                np.add.at(scores, np.repeat((row[a:b] - at) * n_items, reps) + items[where], np.repeat(part[a:b], reps))
                scores = scores.reshape(to - at, n_items)
                r, i = np.nonzero((scores > 0) & (scores >= floor))
                new = np.zeros(len(r), kind)
                new["item"], new["score"], new["bare"], new["first"], new["h"], new["m"] = i, scores[r, i], bare[at + r], first[at + r], h[at + r], m[at + r]
                kept = best(np.concatenate([kept, new]))
                full, counts = np.unique(kept["item"], return_counts=True)
                last = np.cumsum(counts) - 1
                floor[full[counts == top]] = kept["score"][last[counts == top]]
                at = to
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept["item"].astype(np.int32)), pa.array(kept["score"]), pa.array(kept["first"], mask=kept["bare"]), pa.array(kept["h"]), pa.array(kept["m"])],
            ["item", "score", "first", "h", "m"])
    return run


def _classes(digest: DataFrame, n_docs: int, n_terms: int) -> tuple[DataFrame, DataFrame]:
    """The documents with class key (h, m), and the classes (h, m, terms, tfs, members, first), keys verified."""
    m = F.expr(f"100 - 50 + ((50L * n * {n_docs}L) div {n_terms}L)")
    bags = digest.where(F.size("terms") > 0)
    for seed in range(8):
        keyed = bags.select("doc_id", "terms", "tfs", m.alias("m"), F.xxhash64(F.lit(seed), "terms", "tfs").alias("h"))
        classes = written(keyed.groupBy("h", "m", "terms", "tfs").agg(F.count("*").alias("members"), F.min("doc_id").alias("first")), "bag-classes")
        if classes.groupBy("h", "m").count().where("count > 1").isEmpty():
            return keyed, classes
    raise RuntimeError("bags collide under every seed")


def _block(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    # Bounded by BLOCK_PAIRS, or by the text of one item.
    listed = pairs.collect()
    names = sorted({r.item_id for r in listed}, key=lambda i: (i is None, i))
    vocabulary = sorted({r.term for r in listed})
    number = {t: k for k, t in enumerate(vocabulary)}
    place = {i: k for k, i in enumerate(names)}
    postings: list[list[int]] = [[] for _ in vocabulary]
    for r in listed:
        postings[number[r.term]].append(place[r.item_id])
    starts = np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype(np.int64)
    items = np.array([i for p in postings for i in p], dtype=np.int64)

    digest = docs.select("doc_id", whole("text").cast("binary").alias("t")).mapInArrow(
        _counter({t.encode(): k for t, k in number.items()}), "doc_id long, n long, terms array<int>, tfs array<long>")
    digest = written(digest, "bags")
    n_docs, n_terms = digest.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    keyed, classes = _classes(digest, n_docs or 0, n_terms or 1)
    df = classes.select("members", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("members").alias("df"))
    weight = np.zeros(len(vocabulary), dtype=np.int64)
    # One row a vocabulary term.
    for r in df.select("term", F.expr(f"bigint(floor(1000 * ln(double(2 * {n_docs}L + 2) / double(2 * df + 1))))").alias("w")).collect():
        weight[r.term] = r.w
    ranked = classes.select("h", "m", "terms", "tfs", "first").mapInArrow(
        _scorer(weight, starts, items, len(names), top), "item int, score long, first long, h long, m long")
    by_class = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"), "h", "m")
    winners = written(ranked.withColumn("_r", F.row_number().over(by_class)).where(F.col("_r") <= top).select("item", "score", "h", "m"), "bag-winners")
    # At most `top` classes an item, BLOCK_ITEMS items: two numbers each.
    wanted = F.broadcast(winners.select("h", "m").distinct())
    by_id = Window.partitionBy("h", "m").orderBy(F.asc_nulls_last("doc_id"))
    members = keyed.select("doc_id", "h", "m").join(wanted, ["h", "m"]).withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= top).drop("_r")
    by_doc = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = members.join(F.broadcast(winners), ["h", "m"]).withColumn("rank", F.row_number().over(by_doc)).where(F.col("rank") <= top)
    ids = F.broadcast(spark.createDataFrame([(k, i) for i, k in place.items()], f"item int, item_id {pairs.schema['item_id'].dataType.simpleString()}"))
    return out.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents (doc_id, text) of each item (item_id, text), scores above 0.

    Null and empty texts have no terms: such a document does not count and is never found, such an item gets no rows. Rows of
    `items` with one id are one item with the terms of all. Repeated documents count and rank each; a null doc_id ranks after
    all others of its score. Very long texts are counted piece by piece, whole. An empty table gives no rows. Other columns
    of both tables are ignored.
    """
    pairs = written(items.select("item_id", F.explode(F.array_distinct(terms(whole("text")))).alias("term")).distinct(), "item-terms")
    size = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("null"))).alias("items")).first()
    if not size["pairs"]:
        return docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    parts = max(-(-size["pairs"] // BLOCK_PAIRS), -(-size["items"] // BLOCK_ITEMS))
    # Hashed blocks are uneven by a little: half as many again keep them under the bound.
    parts = 1 if parts == 1 else parts + parts // 2
    blocks = [pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) for k in range(parts)]
    return reduce(DataFrame.unionByName, [_block(docs, b, top) for b in blocks if parts == 1 or not b.isEmpty()])
