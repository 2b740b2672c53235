"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and word pairs are taken over all training texts. A count c is kept as its level 1 + floor(log2 c): the
filter holds the pairs (n-gram, 1) to (n-gram, level). A count is read back by probing level after level until one is
absent, so false positives can only raise it, and rarely by much. Probabilities are smoothed towards the word's own, and a
pair is never taken to be more frequent than its words.

The filter is cut into blocks; an n-gram's bits all lie in one block, and each block is built in one task from packed
counts. It has a constant number of bits per training token, and n-grams are fewer than tokens, so false positives do not
grow with the corpus. Up to MOST_BYTES the blocks are broadcast. A larger filter stays a table of blocks: the n-grams of a
chunk of texts are sent to their blocks, each once, and the levels found there are sent back to the chunk. Exact counts
for the base score are joined by word instead: the HEAD commonest words travel with the function, the rest are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import whole
from riskloom.llm.hashing import U64, batches_of_words, mix, slices
from riskloom.llm.langid import held_out
from riskloom.session import written

#: Bits of filter per training token, bits per block, least bits, and the largest filter that is broadcast.
BITS_PER_TOKEN, BLOCK_BITS, LEAST_BITS, MOST_BYTES = 4, 19, 1 << 20, 64 << 20
#: Blocks that are looked up together where the filter is not broadcast.
SHARD = 16
PROBES, LEVELS = 3, 40
#: Pseudo-count of the word's own probability, and the base model's added count.
PRIOR, ADDED = 20.0, 0.1
#: Words whose exact counts travel with the function (16 bytes each).
HEAD = 1 << 16
#: n-grams held by a counting task before it hands them on.
HELD = 1 << 21

END = int(mix(np.array([0x656E64], dtype=U64))[0])
_FP = U64((1 << 40) - 1)


def _tokens(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, token hashes with one end after each text, offsets)."""
    for at, words, offsets in batches_of_words(texts):
        n = len(offsets) - 1
        yield at, np.insert(words, offsets[1:], U64(END)), offsets + np.arange(n + 1)


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """The pair that ends at each token; texts follow an end."""
    return mix(mix(np.concatenate(([U64(END)], tokens[:-1])) + U64(0xA5A5A5A5A5A5A5A5)) + tokens)


def _counted(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    grams, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    return grams, np.bincount(inverse, np.concatenate(counts), len(grams)).astype(np.int64)


def _count(of, emit):
    """Task function: counts `of(tokens)` over all its texts, combined before they leave the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts, held = [], [], 0
        for batch in slices(batches):
            for _, tokens, _ in _tokens([(x or "").encode() for x in batch.column(0).to_pylist()]):
                grams, n = np.unique(of(tokens), return_counts=True)
                parts.append(grams)
                counts.append(n)
                held += len(grams)
                if held > HELD:
                    grams, n = _counted(parts, counts)
                    parts, counts, held = [grams], [n], len(grams)
                    if held > HELD // 2:
                        yield from emit(grams, n)
                        parts, counts, held = [], [], 0
        if parts:
            yield from emit(*_counted(parts, counts))
    return run


def _rows(grams: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(grams), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(grams[at: at + (1 << 18)].view(np.int64)), pa.array(n[at: at + (1 << 18)])], ["word", "n"])


class Filter:
    """Where n-grams lie in a filter of 2^bits bits, and what its bytes say of them."""

    def __init__(self, tokens: int):
        bits = LEAST_BITS
        while bits < BITS_PER_TOKEN * tokens:
            bits *= 2
        self.bytes, self.blocks = bits >> 3, bits >> BLOCK_BITS
        self.shard = min(SHARD, self.blocks)

    def place(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and the 40 bits by which an n-gram is known inside it."""
        shift = 64 - (self.blocks.bit_length() - 1)
        return (grams >> U64(shift) if shift < 64 else np.zeros(len(grams), U64)).astype(np.int64), grams & _FP

    @staticmethod
    def bit(fp: np.ndarray, level: int, probe: int) -> np.ndarray:
        return (mix(fp + U64((level * PROBES + probe + 1) << 41)) >> U64(64 - BLOCK_BITS)).astype(np.int64)

    def pack(self, grams: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts by block, as bytes: five of the n-gram, four of the count."""
        key, fp = self.place(grams)
        order = np.argsort(key, kind="stable")
        key, fp, n = key[order], fp[order], np.minimum(n[order], 0xFFFFFFFF).astype("<u4")
        raw = np.ascontiguousarray(fp.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        spans = list(zip(cuts[:-1], cuts[1:]))
        yield pa.RecordBatch.from_arrays([
            pa.array([int(key[a]) for a, _ in spans], pa.int64()), pa.array([raw[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())], ["key", "grams", "n"])

    def build(self, table: pa.Table) -> pa.Table:
        """One block's bits from its packed counts."""
        raw = np.frombuffer(b"".join(table.column("grams").to_pylist()), np.uint8).reshape(-1, 5)
        fp = np.zeros((len(raw), 8), np.uint8)
        fp[:, :5] = raw
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), "<u4")
        fp, counts = _counted([fp.reshape(-1).view("<u8").astype(U64)], [n])
        level = np.frexp(counts.astype(np.float64))[1]
        bits = np.zeros(1 << BLOCK_BITS, dtype=bool)
        for k in range(1, LEVELS):
            fp, level = fp[level >= k], level[level >= k]
            for j in range(PROBES):
                bits[self.bit(fp, k, j)] = True
        return pa.table({"block": pa.array([table.column("key")[0].as_py()], pa.int64()),
                         "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    def levels(self, data: np.ndarray, block: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """The highest level found in the blocks of `data`, 0 if not even the first is."""
        base, level = block << (BLOCK_BITS - 3), np.zeros(len(fp), np.int64)
        alive = np.arange(len(fp))
        for k in range(1, LEVELS):
            for j in range(PROBES):
                at = self.bit(fp[alive], k, j)
                alive = alive[(data[base[alive] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
            level[alive] = k
            if not len(alive):
                break
        return level

    def counts(self, data: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return _middle(self.levels(data, *self.place(grams)))


def _middle(level: np.ndarray) -> np.ndarray:
    """The count in the middle of a level."""
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1) - 0.5, 0.0)


def train(texts: DataFrame):
    """(words, stats, filter, blocks) of a table with the one column `text`.

    words: a written table of exact counts by word hash; stats: tokens and distinct tokens; blocks: the filter's, as a table.
    """
    words = texts.mapInArrow(_count(lambda t: t, _rows), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, "lm-words")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shape = Filter(tokens)
    schema = "key long, grams binary, n binary"

    def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from shape.pack(mix(batch.column("word").to_numpy().view(U64)), batch.column("n").to_numpy())

    packed = texts.mapInArrow(_count(_pairs, shape.pack), schema).unionByName(words.mapInArrow(pack_words, schema))
    built = packed.groupBy("key").applyInArrow(lambda table: shape.build(table), "block long, bits binary")
    return words, (tokens, distinct), shape, built


ROWS = ("row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<long>, "
        "counts array<long>")


def _scored(stats: tuple[int, int], head: tuple[np.ndarray, np.ndarray]):
    """Function that scores a chunk of texts from the filter's counts of its words and of the pair at each token."""
    tokens_all, distinct = stats
    total = tokens_all + ADDED * (distinct + 1)
    head_words, head_counts = head

    def of(tokens: np.ndarray, offsets: np.ndarray, words: np.ndarray, inverse: np.ndarray, seen: np.ndarray, pair: np.ndarray) -> tuple:
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        # The model: counts of words and of pairs, as the filter remembers them. Every text ends with an end.
        context = np.concatenate((seen[np.searchsorted(words, [U64(END)])], seen[inverse][:-1]))
        pair = np.minimum(pair, np.minimum(context, seen[inverse]))
        own = (seen[inverse] + ADDED) / total
        score = np.add.reduceat(np.log10((pair + PRIOR * own) / (context + PRIOR)), offsets[:-1])
        # The base score: exact counts of common words here, the others by a join.
        at = np.minimum(np.searchsorted(head_words, words), max(len(head_words) - 1, 0))
        in_head = head_words[at] == words if len(head_words) else np.zeros(len(words), bool)
        exact = np.where(in_head, head_counts[at] if len(head_words) else 0, 0)
        logs = np.where(in_head, np.log10(exact + ADDED), 0.0)
        base = np.add.reduceat(logs[inverse], offsets[:-1])
        known = np.add.reduceat(in_head[inverse].astype(np.int64), offsets[:-1])
        left = ~in_head[inverse]
        # One number per text and word of the chunk, so that one sort counts a text's words.
        keys, n = np.unique(owner[left] * len(words) + inverse[left], return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(offsets)) * len(words))
        what = words[keys % len(words)].view(np.int64)
        spans = list(zip(cuts[:-1], cuts[1:]))
        return np.diff(offsets), known, base, score, [what[a:b] for a, b in spans], [n[a:b] for a, b in spans]
    return of


def _out(batch: pa.RecordBatch | pa.Table, done: list[tuple]) -> pa.RecordBatch:
    """The texts' ids beside the results of the chunks they came in."""
    n_tokens, known, base, score = (np.concatenate(x) for x in list(zip(*done))[:4])
    words, counts = (sum(x, []) for x in list(zip(*done))[4:])
    ids = [pa.array(batch.column(c).to_pylist(), t) for c, t in (("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()))]
    return pa.RecordBatch.from_arrays(
        [*ids, pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score), pa.array(words, pa.list_(pa.int64())),
         pa.array(counts, pa.list_(pa.int64()))], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "counts"])


def _score_here(shape: Filter, shared, of):
    """Task function: scores texts by the filter that was broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches):
            done = []
            for _, tokens, offsets in _tokens([(x or "").encode() for x in batch.column("_t").to_pylist()]):
                words, inverse = np.unique(tokens, return_inverse=True)
                done.append(of(tokens, offsets, words, inverse, shape.counts(data, mix(words)), shape.counts(data, _pairs(tokens))))
            yield _out(batch, done)
    return run


def _grams(tokens: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The n-grams a chunk asks for, in order: those of a shard of blocks stand together."""
    return np.unique(np.concatenate((mix(words), _pairs(tokens))))


TEXTS = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("_t", pa.string())]


def _rows_of(columns: dict, names: list[tuple[str, pa.DataType]], size: int) -> pa.RecordBatch:
    """A batch of the named columns, null where not given."""
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(size, t) for c, t in names], [c for c, _ in names])


_SENT = [("shard", pa.int64()), ("block", pa.int64()), ("bits", pa.binary()), ("chunk", pa.int64()), ("grams", pa.binary()), *TEXTS]
_BACK = [("chunk", pa.int64()), ("shard", pa.int64()), ("levels", pa.binary()), *TEXTS]
_DDL = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}


def _ddl(names: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{c} {_DDL[t]}" for c, t in names)


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def _send(shape: Filter):
    """Task function: the n-grams of each chunk by shard, six bytes each, and the chunk's texts, dealt over the shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for first, tokens, offsets in _tokens([(x or "").encode() for x in batch.column("_t").to_pylist()]):
                size = len(offsets) - 1
                part = batch.slice(first, size)
                chunk = part.column("row")[0].as_py()
                own = int(mix(np.array([chunk], U64))[0]) % (shape.blocks // shape.shard)
                yield _rows_of({"shard": pa.array([own] * size), "chunk": pa.array([chunk] * size)} | {c: part.column(c) for c, _ in TEXTS}, _SENT, size)
                block, fp = shape.place(_grams(tokens, np.unique(tokens)))
                inside = (block % shape.shard).astype(U64) << U64(40) | fp
                raw = np.ascontiguousarray(inside.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
                spans = _runs(block // shape.shard)
                yield _rows_of({"shard": pa.array([int(block[a]) // shape.shard for a, _ in spans]), "chunk": pa.array([chunk] * len(spans)),
                                "grams": pa.array([raw[a:b].tobytes() for a, b in spans], pa.binary())}, _SENT, len(spans))
    return run


def _answer(shape: Filter):
    """Task function over rows by shard, its blocks first: the level of each n-gram, one byte; texts pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, held = np.zeros(shape.shard << (BLOCK_BITS - 3), np.uint8), None
        for batch in batches:
            for a, b in _runs(batch.column("shard").to_numpy()):
                part = batch.slice(a, b - a)
                if part.column("shard")[0].as_py() != held:
                    held = part.column("shard")[0].as_py()
                    data[:] = 0
                blocks, asked, texts = (part.filter(part.column(c).is_valid()) for c in ("bits", "grams", "_t"))
                for block, bits in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist()):
                    at = block % shape.shard << (BLOCK_BITS - 3)
                    data[at: at + (1 << (BLOCK_BITS - 3))] = np.frombuffer(bits, np.uint8)
                if asked.num_rows:
                    grams = asked.column("grams").to_pylist()
                    raw = np.zeros((sum(map(len, grams)) // 6, 8), np.uint8)
                    raw[:, :6] = np.frombuffer(b"".join(grams), np.uint8).reshape(-1, 6)
                    inside = raw.reshape(-1).view("<u8").astype(U64)
                    levels = shape.levels(data, (inside >> U64(40)).astype(np.int64), inside & _FP).astype(np.uint8)
                    cuts = np.cumsum([0] + [len(x) // 6 for x in grams])
                    yield _rows_of({"chunk": asked.column("chunk"), "shard": asked.column("shard"), "levels": pa.array(
                        [levels[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())}, _BACK, len(grams))
                if texts.num_rows:
                    yield _rows_of({c: texts.column(c) for c in ("chunk", *(c for c, _ in TEXTS))}, _BACK, texts.num_rows)
    return run


def _score_answered(of):
    """Task function over rows by chunk, then shard, then row: scores a chunk's texts by the levels sent back."""
    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        texts = table.filter(table.column("_t").is_valid())
        level = np.frombuffer(b"".join(x for x in table.column("levels").to_pylist() if x is not None), np.uint8).astype(np.int64)
        (_, tokens, offsets), = _tokens([x.encode() for x in texts.column("_t").to_pylist()])
        words, inverse = np.unique(tokens, return_inverse=True)
        grams, count = _grams(tokens, words), _middle(level)
        seen, pair = (count[np.searchsorted(grams, x)] for x in (mix(words), _pairs(tokens)))
        return _out(texts, [of(tokens, offsets, words, inverse, seen, pair)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk = [], None
        for batch in batches:
            keys = batch.column("chunk").to_numpy()
            for a, b in _runs(keys):
                if held and keys[a] != chunk:
                    yield finish(held)
                    held = []
                chunk = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield finish(held)
    return run


def _rows_scored(frame: DataFrame, shape: Filter, built: DataFrame, of) -> DataFrame:
    """ROWS of a frame of row, doc_id, held_out and _t."""
    if shape.bytes <= MOST_BYTES:
        data = np.zeros(shape.bytes, np.uint8)
        for row in built.collect():  # MOST_BYTES at most
            at = row.block << (BLOCK_BITS - 3)
            data[at: at + (1 << (BLOCK_BITS - 3))] = np.frombuffer(row.bits, np.uint8)
        return frame.mapInArrow(_score_here(shape, frame.sparkSession.sparkContext.broadcast(data.tobytes()), of), ROWS)
    blocks = written(built, "lm-blocks").withColumn("shard", F.floor(F.col("block") / shape.shard).cast("long"))
    sent = frame.mapInArrow(_send(shape), _ddl(_SENT)).unionByName(blocks, allowMissingColumns=True)
    back = sent.repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_last()).mapInArrow(_answer(shape), _ddl(_BACK))
    return back.repartition("chunk").sortWithinPartitions("chunk", "shard", "row").mapInArrow(_score_answered(of), ROWS)


def score(docs: DataFrame, parts: int = 10, part: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of `docs`.

    Learns from rows whose id's checksum does not leave `part`. Null and empty texts are the end token alone. Without
    training tokens every count is 0. Equal texts score alike; other columns are ignored.
    """
    frame = docs.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), whole("text").alias("_t"))
    words, stats, shape, built = train(frame.where(~F.col("held_out")).select(F.col("_t").alias("text")))
    top = words.orderBy(F.desc("n"), "word").limit(HEAD).toPandas()
    order = np.argsort(top["word"].to_numpy(np.int64).view(U64))
    head = top["word"].to_numpy(np.int64).view(U64)[order], top["n"].to_numpy(np.int64)[order]
    rows = _rows_scored(frame.withColumn("row", F.monotonically_increasing_id()), shape, built, _scored(stats, head))
    rows = written(rows, "lm-rows")
    rest = rows.select("row", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.counts").alias("times"))
    found = rest.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))
    tokens, distinct = stats
    scale = float(np.log10(tokens + ADDED * (distinct + 1)))
    return rows.drop("words", "counts").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score")
