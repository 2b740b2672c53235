"""Language identification by a byte convolutional network, trained in numpy on labelled text.

A text's UTF-8 bytes are cut into windows of fixed length, all of them, the last one padded. Bytes are embedded, filters of
several widths slide over them, each filter keeps its largest response in the window, and a linear layer with softmax gives
the languages. A text's probabilities are the windows' log-probabilities averaged by the bytes they hold.

The network is fitted on a bounded sample of the labelled rows, SAMPLE different texts dealt by language, each language's
first in order of a hash; the weights (a few thousand numbers, whatever the input) travel to the tasks with the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.columns import Carried, whole

WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 5), 12
#: Labelled rows fitted on, windows taken of each, passes, rows per step, and step size.
SAMPLE, WINDOWS_EACH, EPOCHS, STEP, RATE = 3000, 4, 4, 64, 0.01
#: Windows worked on at once in a task.
BLOCK = 128
SEED = 7


class ByteCnn:
    def __init__(self, labels: list[str]):
        rng = np.random.default_rng(SEED)
        self.labels = labels
        shapes = {"embed": (256, EMBED), "out": (len(WIDTHS) * FILTERS, len(labels)), "bias": (len(labels),)}
        shapes |= {f"w{k}": (k * EMBED, FILTERS) for k in WIDTHS} | {f"b{k}": (FILTERS,) for k in WIDTHS}
        self.p = {n: (rng.standard_normal(s) * (0.0 if n[0] == "b" else 1 / np.sqrt(max(s[0] if n != "embed" else 1, 1)))).astype(np.float32)
                  for n, s in shapes.items()}

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, list]:
        """Log-probabilities of each window and, per width, what training needs of its largest responses."""
        x = self.p["embed"][windows].reshape(len(windows), WINDOW * EMBED)
        pooled, kept = [], []
        for k in WIDTHS:
            n = WINDOW - k + 1
            # Overlapping runs of k embedded bytes, seen in place.
            runs = np.lib.stride_tricks.as_strided(x, (len(x), n, k * EMBED), (x.strides[0], EMBED * x.itemsize, x.itemsize))
            answers = runs.reshape(-1, k * EMBED) @ self.p[f"w{k}"]
            answers = answers.reshape(len(x), n, FILTERS)
            kept.append(answers)
            pooled.append(np.maximum(answers.max(axis=1) + self.p[f"b{k}"], 0))
        features = np.concatenate(pooled, axis=1)
        logits = features @ self.p["out"] + self.p["bias"]
        logits = logits - logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)), [features, *kept]

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Per width, what each pair of bytes (or the odd last byte) adds to the filters, so that a window is looked up."""
        out = {}
        for k in WIDTHS:
            each = [self.p["embed"] @ self.p[f"w{k}"][i * EMBED:(i + 1) * EMBED] for i in range(k)]
            pairs = [(each[i][:, None] + each[i + 1][None]).reshape(65536, FILTERS) for i in range(0, k - 1, 2)]
            out[k] = [np.ascontiguousarray(t, dtype=np.float32) for t in pairs + ([each[-1]] if k % 2 else [])]
        return out

    def predict(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Log-probabilities of each window: what `forward` gives, from the tables."""
        data = np.ascontiguousarray(windows.T).astype(np.intp)
        pairs = data[:-1] * 256 + data[1:]
        pooled = []
        for k in WIDTHS:
            n = WINDOW - k + 1
            answers = tables[k][0][pairs[:n]]
            for i, table in enumerate(tables[k][1:], 1):
                answers += table[pairs[2 * i: 2 * i + n] if len(table) > 256 else data[2 * i: 2 * i + n]]
            pooled.append(np.maximum(answers.max(axis=0) + self.p[f"b{k}"], 0))
        logits = np.concatenate(pooled, axis=1) @ self.p["out"] + self.p["bias"]
        logits = logits - logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def gradients(self, windows: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        logs, (features, *answers) = self.forward(windows)
        error = np.exp(logs)
        error[np.arange(len(truth)), truth] -= 1
        error /= len(truth)
        grads = {"out": features.T @ error, "bias": error.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        back = (error @ self.p["out"].T) * (features > 0)
        embedded = self.p["embed"][windows]
        for i, k in enumerate(WIDTHS):
            part = back[:, i * FILTERS:(i + 1) * FILTERS]
            at = answers[i].argmax(axis=1)
            # Only the run with the largest response of each filter gets a gradient.
            places = at[:, :, None] + np.arange(k)
            rows = np.arange(len(windows))[:, None, None]
            runs = embedded[rows, places].reshape(len(windows), FILTERS, k * EMBED)
            grads[f"w{k}"] = np.einsum("nf,nfe->ef", part, runs)
            grads[f"b{k}"] = part.sum(axis=0)
            to_bytes = (part[:, :, None] * self.p[f"w{k}"].T[None]).reshape(len(windows), FILTERS, k, EMBED)
            np.add.at(grads["embed"], windows[rows, places], to_bytes)
        return grads

    def fit(self, windows: np.ndarray, truth: np.ndarray) -> ByteCnn:
        rng = np.random.default_rng(SEED + 1)
        mean, square = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), STEP):
                pick = order[at: at + STEP]
                step += 1
                for n, g in self.gradients(windows[pick], truth[pick]).items():
                    mean[n] = 0.9 * mean[n] + 0.1 * g
                    square[n] = 0.99 * square[n] + 0.01 * g * g
                    self.p[n] -= (RATE * (mean[n] / (1 - 0.9 ** step)) / (np.sqrt(square[n] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, at least one; the last is padded with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def _quotas(sizes: dict[str, int], total: int) -> dict[str, int]:
    """How many texts of each language: equal shares, and what a small language leaves goes to the others."""
    out, left = {}, total
    for n, lang in enumerate(sorted(sizes, key=lambda k: (sizes[k], k))):
        out[lang] = max(1, min(sizes[lang], left // (len(sizes) - n)))
        left = max(0, left - out[lang])
    return out


def fit(labelled: DataFrame, size: int = SAMPLE) -> ByteCnn | None:
    """The network for `labelled` (text, lang), or None if it has no text. Rows without text or lang are left out.

    The sample is dealt by language, and copies of a text count once: neither a language with most rows nor a text with most
    rows takes the place of others.
    """
    order = F.xxhash64("text", "lang")
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("text", "lang")
    # The sample's texts are bounded as well: WINDOWS_EACH windows spread over the whole text.
    piece = F.greatest(F.lit(1), F.floor(F.length("text") / WINDOWS_EACH)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_EACH - 1)), lambda i: F.substr("text", i * piece + 1, F.lit(WINDOW)))
    # One row a language.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(order).alias("n")).collect()}
    if not sizes:
        return None
    quota = _quotas(sizes, size)
    # Only hashes below a language's bound are looked at, about twice as many texts as are wanted; tasks send no more.
    bounds = [(k, n, int(min(1.0, 2 * n / max(1, sizes[k])) * (1 << 40))) for k, n in quota.items()]
    wanted = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, quota int, bound long"))
    few = rows.join(wanted, "lang").where(F.pmod(order, F.lit(1 << 40)) < F.col("bound"))
    each = few.select(order.alias("o"), "lang", "quota", pieces.alias("pieces")).dropDuplicates(["o", "lang"])
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o", "pieces"))).where("n <= quota")
    sample = ranked.orderBy("o", "lang", "pieces").select("lang", "pieces").collect()
    if not sample:
        return None
    labels = sorted({r.lang for r in sample})
    cut = [(windows_of(p.encode()[:WINDOW])[0], labels.index(r.lang)) for r in sample for p in r.pieces if p]
    return ByteCnn(labels).fit(np.stack([w for w, _ in cut]), np.array([y for _, y in cut]))


def _predict(model: ByteCnn | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            texts = batch.column("_t").to_pylist()
            todo = [i for i, ok in enumerate(batch.column("_letters").to_pylist()) if ok and model]
            at = 0
            while at < len(todo):
                # Texts together up to a block of windows; a longer text is worked off block by block.
                group, size = [], 0
                while at < len(todo) and (not group or size < BLOCK):
                    group.append((todo[at], windows_of(texts[todo[at]].encode())))
                    size += len(group[-1][1])
                    at += 1
                every = np.concatenate([w for _, w in group])
                logs = np.concatenate([model.predict(every[k: k + BLOCK], tables) for k in range(0, len(every), BLOCK)])
                held = (every != 0).sum(axis=1)[:, None]
                starts = np.cumsum([0] + [len(w) for _, w in group[:-1]])
                sums = np.add.reduceat(logs * held, starts) / np.maximum(np.add.reduceat(held, starts), 1)
                shares = np.exp(sums - sums.max(axis=1, keepdims=True))
                shares /= shares.sum(axis=1, keepdims=True)
                for (i, _), row in zip(group, shares):
                    langs[i], scores[i] = model.labels[int(row.argmax())], float(row.max())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names if c not in ("_t", "_letters")], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*[c for c in batch.schema.names if c not in ("_t", "_letters")], "lang_pred", "score"])
    return run


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """The rows whose checksum of the id leaves `part`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, model: ByteCnn | None, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs` with lang_pred and score (the predicted language's share of the window average).

    `und` with score 0 for null text, text without a letter, or no model. Equal texts get equal predictions; repeated rows stay,
    an empty table gives no rows. Long texts are read whole, window by window. Columns of `keep` named lang_pred or score are replaced.
    """
    text, carried = whole("text"), Carried(docs.select(*keep), ("lang_pred", "score"))
    frame = docs.select(*carried.inside(), text.alias("_t"), text.rlike(r"\p{L}").alias("_letters"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema[:-2])
    made = frame.mapInArrow(_predict(model), f"{schema}, lang_pred string, score double")
    return made.select(*carried.outside(), "lang_pred", "score")
