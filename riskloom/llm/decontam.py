"""Benchmark decontamination: prefix-filtered containment join of item windows against whole documents.

A window is 13 consecutive words of an item (a shorter item is one window). Because a window must be contained whole, one
token of it is a sufficient prefix: tokens are ordered by their count in all documents and only the rarest token of each
window, with its offset, is joined to document words. The offset fixes where the window would have to begin (positional
bound), the document's length bounds its end, and the words there are then compared one by one.

Items are joined in blocks of bounded size. Only the current block is broadcast, after its rows are counted, so a large
benchmark costs more passes and not more memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import Carried, bench_words, text_key, whole
from riskloom.session import written

WINDOW = 13
#: Windows broadcast at once; each is at most WINDOW words.
BLOCK_WINDOWS = 200_000


def windows(items: DataFrame) -> DataFrame:
    """item_id, w (array of words), k (its length): the distinct windows of all items that have a word."""
    words = items.select("item_id", bench_words(whole("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - WINDOW + 1, F.lit(1)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("_w", i, WINDOW))).alias("w"))
    return cut.distinct().withColumn("k", F.size("w"))


def _blocks(frame: DataFrame, rows: int) -> list[DataFrame]:
    """The frame, written once, in parts of at most about `rows` rows each."""
    parts = max(1, -(-rows // BLOCK_WINDOWS))
    if parts == 1:
        return [frame]
    return [frame.where(F.pmod(F.xxhash64("w"), F.lit(parts)) == i) for i in range(parts)]


def anchored(docs: DataFrame, items: DataFrame) -> list[DataFrame]:
    """Blocks of windows, each with its rarest word in `docs` (ties by the word) and that word's first offset."""
    wins = written(windows(items), "bench-windows")
    rows = wins.count()
    words = docs.select(F.explode(bench_words(whole("text"))).alias("word"))
    ranked = []
    for block in _blocks(wins, rows):
        # A block's words and their counts are as bounded as the block.
        vocabulary = block.select(F.explode("w").alias("word")).distinct()
        count = words.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
        ranked.append(block.select("item_id", "w", "k", F.posexplode("w").alias("at", "word"))
                      .join(F.broadcast(count), "word", "left")
                      .groupBy("item_id", "w", "k")
                      .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("anchor")))
    ranked = reduce(DataFrame.unionByName, ranked)
    kept = ranked.where(F.col("anchor.n") > 0).select("item_id", "w", "k", F.col("anchor.word").alias("anchor"), F.col("anchor.at").alias("at"))
    return _blocks(written(kept, "bench-anchors"), rows)


def mark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, item_ids, contaminated: one row per row of `docs`.

    Null and empty texts have no words and are clean. Equal rows give equal rows, as many as came. Items without words
    and items with a null id never appear in item_ids; a null id still marks words. Other columns are ignored.
    """
    blocks = anchored(docs, items)
    base = docs.select("doc_id", whole("text").alias("_t")).select(
        "doc_id", text_key(F.col("_t")).alias("text_key"), bench_words(F.col("_t")).alias("_w"))
    # The last element belongs to no window: it keeps one row per document through the join.
    tokens = base.select("doc_id", "text_key", "_w", F.size("_w").alias("n_words"), F.posexplode(F.array_append("_w", "")).alias("pos", "word"))
    found = []
    for n, block in enumerate(blocks):
        joined = tokens.join(F.broadcast(block), tokens["word"] == block["anchor"], "left")
        start = F.col("pos") - F.col("at")
        fits = (start >= 0) & (start + F.col("k") <= F.col("n_words"))
        hit = fits & (F.slice("_w", F.greatest(start + 1, F.lit(1)), F.greatest("k", F.lit(0))) == F.col("w"))
        last = F.col("pos") == F.col("n_words")
        found.append(joined.where(hit | last).select(
            "doc_id", "text_key", "n_words", (last & F.lit(n == 0)).cast("long").alias("rows"),
            F.when(hit, F.struct(start.alias("s"), (start + F.col("k")).alias("e"))).alias("span"), F.when(hit, F.col("item_id")).alias("item_id")))
    per_text = reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_key", "n_words").agg(
        F.sum("rows").alias("rows"), F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("item_ids"))
    # Spans in order: each adds what reaches beyond the ones before it.
    n_hit = F.aggregate(F.sort_array("spans"), F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
                        lambda a, x: F.struct(F.greatest(a["to"], x["e"]).alias("to"),
                                              (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n")), lambda a: a["n"])
    out = per_text.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                          F.sort_array(F.col("item_ids").cast("array<string>")).alias("item_ids"), "rows")
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    copies = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return out.withColumn("_copy", copies).drop("rows", "_copy")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` whose text is not contaminated, with all their columns."""
    bad = written(mark(docs, items).where("contaminated").select("text_key").distinct(), "contaminated")
    carried = Carried(docs)
    frame = docs.select(*carried.inside(), text_key(whole("text")).alias("text_key"))
    return frame.join(bad, "text_key", "left_anti").select(*carried.outside())
