"""Exact cosine neighbours over vector tables.

Few queries: their matrix (size checked) goes to every task and the vectors stay where they are.
Many queries: a metric index (`operators.vector_index`) tells which blocks of vectors have to be compared.
Either way a task keeps only its k best per query, so the final ranking sees little data.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import vector_index
from riskloom.operators.vector_index import DIGITS
from riskloom.operators.vector_index import unit_rows as _unit

MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _best(q_ids, q_unit, v_ids, v_unit, k: int, skip_self: bool, floor: float | None) -> pd.DataFrame:
    """The k best vectors per query by (rounded similarity, id); all above the floor when k is 0."""
    sims = np.round(q_unit @ v_unit.T, DIGITS)
    if skip_self:
        sims[q_ids[:, None] == v_ids[None, :]] = -2.0
    if floor is not None:
        sims[sims < floor] = -2.0
    if k and k < sims.shape[1]:
        edge = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
        keep = sims >= edge[:, None]
    else:
        keep = np.ones_like(sims, dtype=bool)
    rows, cols = np.nonzero(keep & (sims > -2.0))
    values = sims[rows, cols]
    if k:
        order = np.lexsort((v_ids[cols], -values, rows))
        rows, cols, values = rows[order], cols[order], values[order]
        first = np.searchsorted(rows, rows, side="left")
        near = np.arange(len(rows)) - first < k
        rows, cols, values = rows[near], cols[near], values[near]
    return pd.DataFrame({"query_id": q_ids[rows], "vec_id": v_ids[cols], "similarity": values})


_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
    T.StructField("similarity", T.DoubleType())])


def neighbours(
    queries: DataFrame, vectors: DataFrame, k: int = 5, floor: float | None = None, skip_self: bool = False,
    block: int = 4096,
) -> DataFrame:
    """(query_id, vec_id, similarity): the k best per query, or all at or above `floor` when k is 0.

    Both inputs have columns (id, vector).
    """
    if not k and floor is None:
        raise ValueError("either k or a floor is needed")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if (size["n"] or 0) * (size["d"] or 0) * 8 <= MAX_BROADCAST_BYTES and size["n"] <= block:
        found = _by_broadcast(queries, vectors, k, floor, skip_self)
    else:
        find = vector_index.k_nearest if k else vector_index.all_at_least
        found, _ = find(queries, vectors, k, floor, skip_self, block)
    if not k:
        return found
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _by_broadcast(queries, vectors, k, floor, skip_self) -> DataFrame:
    rows = queries.select("id", "vector").collect()
    if not rows:
        return vectors.sparkSession.createDataFrame([], _SCHEMA)
    ids = np.array([r["id"] for r in rows], dtype=np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, _unit([r["vector"] for r in rows])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_unit = shared.value
        kept = None
        for pdf in batches:
            if pdf.empty:
                continue
            part = _best(q_ids, q_unit, pdf["id"].to_numpy(np.int64), _unit(pdf["vector"]), k, skip_self, floor)
            if not k:
                yield part
                continue
            kept = part if kept is None else pd.concat([kept, part])
            kept = kept.sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True])
            kept = kept.groupby("query_id", sort=False).head(k)
        if kept is not None:
            yield kept

    return vectors.select("id", "vector").mapInPandas(scan, _SCHEMA)


def best_match(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Largest similarity per query."""
    return neighbours(queries, vectors, k=1).select("query_id", "similarity")


def head_of(vectors: DataFrame) -> DataFrame:
    """(id, head): the smallest id with the same vector; a vector's own id if there is no copy before it."""
    marked = vectors.select("id", F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256).alias("_key"))
    return marked.join(marked.groupBy("_key").agg(F.min("id").alias("head")), "_key").select("id", "head")


def head_edges(vectors: DataFrame, heads: DataFrame, floor: float, block: int = 4096) -> DataFrame:
    """Edges (src < dst) at or above the floor among different vectors, each named by its head."""
    base = vectors.join(heads.where("id = head").select("id"), "id", "left_semi").select("id", "vector")
    found, _ = vector_index.edges_at_least(base, floor, block)
    return found.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "similarity")


def similar_edges(vectors: DataFrame, floor: float, block: int = 4096, stars: bool = True) -> DataFrame:
    """Undirected SIMILAR_TO edges (src < dst) at or above the floor: of all pairs, or with copies as one node if `stars`.

    As stars, copies are linked to the first of their group (similarity 1) and take no part otherwise: a large group of copies
    gives a star and not all its pairs, and its other edges are those of its head. Without, no pair is left out; pairs go
    straight from the comparison to the result, so a large group of copies costs its pairs' output and nothing else.
    """
    if not stars:
        found, _ = vector_index.edges_at_least(vectors, floor, block)
        return found.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "similarity").where("src < dst")
    heads = head_of(vectors)
    copies = heads.filter("id <> head").select(F.col("head").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("similarity"))
    return head_edges(vectors, heads, floor, block).unionByName(copies)


def pseudo_embedding(text: Column, dims: int = 768) -> Column:
    """The md5 bytes of a text over 255, padded with zeros: a stand-in when no model is at hand."""
    digest = F.md5(text)
    values = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)
    return F.concat(values, F.array_repeat(F.lit(0.0), dims - 16))


def index_rows(df: DataFrame, id_col: str, vector: str, document: Column, metadata: Mapping[str, Column]) -> DataFrame:
    """Pattern rows (id, vector, document, metadata) ready to be written."""
    return df.select(
        F.col(id_col).alias("id"), F.col(vector).alias("vector"), document.alias("document"),
        F.struct(*[c.alias(n) for n, c in metadata.items()]).alias("metadata"))


def remove_patterns(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")
