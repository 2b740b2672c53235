"""Substring dedup over sliding sentence spans.

A text is cut into sentences: words up to a full stop, exclamation or question mark, or up to a line's end. Sentences of
more than LONG words are cut further, after the word of the least hash of every LONG words in a row (all of them, if there
are several), so no sentence keeps more than LONG words, and cuts depend on fewer than LONG words to either side. A passage
of over 50 words that stands twice therefore holds a common span, whatever its sentence ends: a cut lies within its first
15 words, the least run from there ends within 27 more, and only cuts after its last 7 or 8 words may differ. Every run of consecutive sentences that just reaches MIN_SENTENCES and MIN_WORDS, counted from its first
or from its last sentence, is hashed. Spans are counted over all documents; where a span stands more than once, the first
place (by doc_id, then position; null ids last) stays and the sentences of all other places are removed.

Counts are combined before they are shuffled, and only spans known to repeat are followed to their places, by joins that
split a span found in very many documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import whole
from riskloom.llm.hashing import U64, chunks, mix, word_hashes
from riskloom.session import written

MIN_SENTENCES, MIN_WORDS, LONG = 3, 20, 8
_BASE = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(int(_BASE), -1, 1 << 64))


def _least(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words that have the least hash of some LONG words in a row of one sentence."""
    chosen = np.zeros(len(words), bool)
    if len(words) < LONG:
        return chosen
    sentence = np.cumsum(last) - last
    n = len(words) - LONG + 1
    least = words[:n].copy()
    for k in range(1, LONG):
        np.minimum(least, words[k: n + k], out=least)
    inside = sentence[:n] == sentence[LONG - 1:]
    for k in range(LONG):
        chosen[k: n + k] |= inside & (words[k: n + k] == least)
    return chosen


def _cut(buffer: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word hashes, first words of the sentences and of each text, and byte ranges of the words."""
    words, starts, ends = word_hashes(buffer)
    texts = np.searchsorted(starts, begins)
    if not len(words):
        return words, np.zeros(0, np.int64), texts, starts, ends
    lines = np.cumsum(buffer == 10)
    last = np.isin(buffer[ends - 1], np.frombuffer(b".!?", np.uint8))
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1] - 1]
    last[-1] = True
    last[texts[1:][texts[1:] > 0] - 1] = True
    size = np.diff(np.concatenate(([0], np.flatnonzero(last) + 1)))
    last |= np.repeat(size > LONG, size) & _least(words, last)
    return words, np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)), texts, starts, ends


def _runs(words: np.ndarray, firsts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, first sentence, sentence after the last, and text of each run; sentences are numbered over the chunk."""
    n = len(firsts)
    edge = np.append(firsts, len(words))
    text = np.searchsorted(texts, firsts, side="right") - 1
    sentences = np.append(np.searchsorted(firsts, texts[:-1]), n)
    low, high = sentences[text], sentences[text + 1]
    each = np.arange(n)
    # The least run from a sentence on, and the least run up to it.
    to = np.maximum(each + MIN_SENTENCES, np.searchsorted(edge, edge[:-1] + MIN_WORDS))
    since = np.minimum(each + 1 - MIN_SENTENCES, np.searchsorted(edge, edge[1:] - MIN_WORDS, side="right") - 1)
    ahead, behind = to <= high, since >= low
    pairs = np.unique(np.concatenate((each[ahead] * (n + 1) + to[ahead], since[behind] * (n + 1) + each[behind] + 1)))
    first, after = pairs // (n + 1), pairs % (n + 1)
    powers = np.cumprod(np.concatenate(([U64(1)], np.full(max(len(words) - 1, 0), _BASE))))
    back = np.cumprod(np.concatenate(([U64(1)], np.full(max(len(words) - 1, 0), _BACK))))
    sums = np.concatenate(([U64(0)], np.cumsum(words * powers)))
    a, b = edge[first], edge[after]
    return mix((sums[b] - sums[a]) * back[a] + (b - a).astype(U64)), first - low[first], after - low[first], text[first]


def _spans(places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode() for x in batch.column("text").to_pylist()]
            for at, buffer, begins in chunks(texts):
                words, firsts, offsets, _, _ = _cut(buffer, begins)
                if not len(words):
                    continue
                span, first, after, text = _runs(words, firsts, offsets)
                if not places:
                    span, n = np.unique(span, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(span.view(np.int64)), pa.array(n.astype(np.int64))], ["span", "n"])
                    continue
                rows = pa.array(at + text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(span.view(np.int64)), batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array((first << 32) | after)],
                    ["span", "doc_id", "key", "place"])
    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without the sentences of its places; what stands between two removed sentences goes with them."""
    for batch in batches:
        texts, places = batch.column("text").to_pylist(), batch.column("places").to_pylist()
        totals, gone, kept = [], [], []
        for text, ranges in zip(texts, places):
            data = text.encode()
            words, firsts, _, starts, _ = _cut(np.frombuffer(data, np.uint8), np.array([0, len(data) + 1]))
            mark = np.zeros(len(firsts) + 1, np.int64)
            for place in ranges or ():
                mark[place >> 32] += 1
                mark[place & 0xFFFFFFFF] -= 1
            out = np.cumsum(mark[:-1]) > 0
            totals.append(len(firsts))
            gone.append(int(out.sum()))
            if not out.any():
                kept.append(text)
                continue
            edge = np.append(starts[firsts], len(data))
            edge[0] = 0
            kept.append(b"".join(data[edge[i]: edge[i + 1]] for i in np.flatnonzero(~out)).strip(b" \t\n\x0b\f\r").decode())
        names = [c for c in batch.schema.names if c not in ("text", "places")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            [*names, "n_sentences", "n_removed", "text"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, text: one row per row of `docs`, the text without its non-first repeated spans.

    Null text counts as empty. Rows with the same id and text are one place and keep or lose the same sentences; other
    columns are ignored.
    """
    frame = docs.select("doc_id", whole("text").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    counts = frame.select("text").mapInArrow(_spans(False), "span long, n long").groupBy("span").agg(F.sum("n").alias("n"))
    repeated = written(counts.where("n > 1").select("span"), "spans-repeated")
    found = frame.mapInArrow(_spans(True), "span long, doc_id long, key long, place long").join(repeated, "span")
    found = written(found, "spans-found")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("place").alias("p"))
    # Written, so that the join deals the places out anew and can split a span that has very many.
    first = written(found.groupBy("span").agg(F.min(order).alias("first")), "spans-first")
    later = found.join(first, "span").where(order != F.col("first"))
    # A place is a long and a document has as many as it has sentences, twice at most.
    places = later.groupBy("key").agg(F.collect_set("place").alias("places"))
    return frame.join(places, "key", "left").select("doc_id", "text", "places").mapInArrow(
        _removed, "doc_id long, n_sentences long, n_removed long, text string")
