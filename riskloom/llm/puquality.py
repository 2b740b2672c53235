"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it learns from; no negative label is used. The share of positives among the
unlabelled (the class prior) is estimated from the scores of a first classifier of positives against unlabelled text: above a
threshold nearly free of negatives, the unlabelled share over the positives' share is the prior, and the threshold with the
least upper confidence bound is taken. The final network then minimises the non-negative unbiased risk

    prior * R(positives as positive) + max(0, R(unlabelled as negative) - prior * R(positives as negative))

by logistic loss: where the second part turns negative, its descent is undone for that step.

Features are counts over the whole text, worked off piece by piece. Both samples are bounded (SAMPLE different texts each).
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import Carried, whole
from riskloom.session import written

#: Different texts fitted on, of the positives and of the unlabelled.
SAMPLE = 4000
HIDDEN, EPOCHS, STEP, RATE, DECAY, SEED = 16, 40, 256, 0.01, 1e-4, 11
#: Confidence of the prior's bound, and the range it is held in.
DELTA, LEAST, MOST = 0.1, 0.05, 0.98
THRESHOLD = 0.3
#: Bytes worked on at once, and words among which repeats are counted.
PIECE, NEAR = 1 << 20, 64
BUCKETS = 64

_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",;:", b"!?", b"'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t\r\x0b\x0c", b"\n")
_CLASS = np.full(256, len(_GROUPS) + 1, dtype=np.intp)
for _k, _bytes in enumerate(_GROUPS):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = len(_GROUPS)
_CLASSES = len(_GROUPS) + 2
#: Counts of a text: bytes by class, words, runs of equal words, words new among NEAR, words without letters, words in capitals,
#: words that end in a mark other than a comma or full stop, squared word length, lines, new lines among a piece's, byte pairs by bucket.
_COUNTS = _CLASSES + 9 + BUCKETS

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MARKS = tuple(bytes([c]) for c in b"!#$%&*<>|~^=+@/")


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in parts cut at a space or line end; a part without one is cut anywhere."""
    at = 0
    while len(data) - at > PIECE:
        cut = max(data.rfind(b" ", at, at + PIECE), data.rfind(b"\n", at, at + PIECE))
        cut = at + PIECE if cut <= at else cut
        yield data[at:cut]
        at = cut
    yield data[at:]


def counts(data: bytes) -> np.ndarray:
    out = np.zeros(_COUNTS)
    for piece in _pieces(data):
        values = np.frombuffer(piece, dtype=np.uint8)
        out[:_CLASSES] += np.bincount(_CLASS, weights=np.bincount(values, minlength=256), minlength=_CLASSES)
        words, lines = piece.split(), [x for x in piece.split(b"\n") if x.strip()]
        own = out[_CLASSES:_CLASSES + 9]
        own[0] += len(words)
        own[1] += sum(map(operator.eq, words, words[1:]))
        own[2] += sum(len(set(words[i:i + NEAR])) for i in range(0, len(words), NEAR))
        own[3] += sum(1 for w in words if not w.translate(None, b"0123456789.,;:!?'\"()-#$%&*+/<=>@[\\]^_`{|}~"))
        own[4] += sum(map(bytes.isupper, words))
        own[5] += sum(1 for w in words if w.endswith(_MARKS))
        own[6] += sum(n * n for n in map(len, words))
        own[7] += len(lines)
        own[8] += len(set(lines))
        folded = np.frombuffer(piece.translate(_FOLD), dtype=np.uint8).astype(np.uint32)
        if len(folded) > 1:
            out[_CLASSES + 9:] += np.bincount(((folded[:-1] * 251 + folded[1:]) * np.uint32(2654435761)) >> np.uint32(26), minlength=BUCKETS)
    return out


def features(rows: np.ndarray) -> np.ndarray:
    """Shares from counts; an empty text has zeros."""
    size, (words, runs, new, bare, capital, marked, square, lines, fresh) = rows[:, :_CLASSES].sum(axis=1), rows[:, _CLASSES:_CLASSES + 9].T
    def share(part, of):
        return np.divide(part, of, out=np.zeros_like(part), where=of > 0)

    letters = size - rows[:, len(_GROUPS) - 2] - rows[:, len(_GROUPS) - 1]
    mean = share(letters, words)
    spread = np.sqrt(np.maximum(share(square, words) - mean ** 2, 0))
    # Few words say little: shares of repeats shrink towards none.
    sure = words / (words + 8)
    own = [np.log1p(words), share(runs, words) * sure, share(words - new, words) * sure, share(bare, words), share(capital, words) * sure,
           share(marked, words), np.log1p(mean), np.log1p(spread), share(lines - fresh, lines)]
    pairs = rows[:, _CLASSES + 9:]
    return np.column_stack([np.sqrt(share(rows[:, :_CLASSES], size[:, None].repeat(_CLASSES, 1))), *own, np.sqrt(share(pairs, pairs.sum(axis=1, keepdims=True).repeat(BUCKETS, 1)))])


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = HIDDEN):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.p = {"w": rng.standard_normal((len(mean), hidden)) / np.sqrt(len(mean)), "b": np.zeros(hidden), "v": rng.standard_normal(hidden) / np.sqrt(hidden), "c": np.zeros(1)}

    def shape(self, x: np.ndarray) -> np.ndarray:
        # A feature that hardly varied in the sample must not decide alone.
        return np.clip((x - self.mean) / self.scale, -30, 30)

    def margin(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p["w"] + self.p["b"]) @ self.p["v"] + self.p["c"][0]

    def gradients(self, z: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
        h = np.tanh(z @ self.p["w"] + self.p["b"])
        back = slope[:, None] * self.p["v"][None] * (1 - h * h)
        return {"w": z.T @ back, "b": back.sum(axis=0), "v": h.T @ slope, "c": np.array([slope.sum()])}

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.shape(x)), -40, 40)))


def _softplus(m: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, m)


def risk_parts(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Of the margins: the positives' part of the risk, and the part that must not be negative."""
    return prior * _softplus(-positive).mean(), _softplus(unlabelled).mean() - prior * _softplus(positive).mean()


def train(net: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Network:
    """Minimise the non-negative risk for a prior; without one, the plain risk of positives against unlabelled."""
    rng = np.random.default_rng(SEED + 1)
    p, u = net.shape(positive), net.shape(unlabelled)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order_u = rng.permutation(len(u))
        parts = max(1, len(u) // STEP)
        # As many steps as the unlabelled fill; positives are dealt over them, each in every pass.
        order_p = np.resize(rng.permutation(len(p)), max(len(p), parts))
        for mine_u, mine_p in zip(np.array_split(order_u, parts), np.array_split(order_p, parts)):
            zp, zu = p[mine_p], u[mine_u]
            mp, mu = net.margin(zp), net.margin(zu)
            sp, su = 1 / (1 + np.exp(-mp)), 1 / (1 + np.exp(-mu))
            if prior is None:
                slope = [(sp - 1) / len(mp), su / len(mu)]
            else:
                slope = [prior * (sp - 1) / len(mp) - prior * sp / len(mp), su / len(mu)]
                if risk_parts(mp, mu, prior)[1] < 0:
                    slope = [prior * sp / len(mp), -su / len(mu)]
            step += 1
            grads = net.gradients(np.concatenate([zp, zu]), np.concatenate(slope))
            for k, g in grads.items():
                g = g + DECAY * net.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.p[k] = net.p[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores that neither sample's classifier was fitted on."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    above_p = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / DELTA) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / DELTA) / (2 * len(positive)))
    some = above_p > 0
    bound = (above_u[some] + slack) / above_p[some]
    at = int(np.argmin(bound))
    return float(np.clip(above_u[some][at] / above_p[some][at], LEAST, MOST))


class Model:
    def __init__(self, net: Network, prior: float):
        self.net, self.prior = net, prior


def learn(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The model of two feature tables."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    rng = np.random.default_rng(SEED + 2)
    side_p, side_u = rng.random(len(positive)) < 0.5, rng.random(len(unlabelled)) < 0.5
    prior = MOST
    if min(side_p.sum(), (~side_p).sum(), side_u.sum(), (~side_u).sum()) >= 10:
        guesses = []
        for a, b in ((side_p, side_u), (~side_p, ~side_u)):
            net = train(Network(mean, scale), positive[a], unlabelled[b], None)
            guesses.append(estimate_prior(net.score(positive[~a]), net.score(unlabelled[~b])))
        prior = float(np.mean(guesses))
    return Model(train(Network(mean, scale), positive, unlabelled, prior), prior)


def _measured(keep: int):
    """The first `keep` columns, and the counts of `_t`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t.as_py()) for t in batch.column("_t")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names[:keep], "counts"])
    return run


def _first(hashes: DataFrame, n: int) -> DataFrame:
    """About n rows of (h, doc_id), the first in order of h; all if there are fewer."""
    share = min(1.0, 2 * n / max(1, hashes.count()))
    # h is uniform over 64 bits: tasks send rows below a bound only.
    return hashes.where(F.shiftrightunsigned("h", 24) < int(share * (1 << 40))).orderBy("h").limit(n)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model for the texts of `docs` (doc_id, text) and the trusted positives among them by `labels` (doc_id, quality).

    Only ids labelled 1 in every row of theirs are positives; other labels are not looked at. Copies of a text count once, so a
    text with a third of all rows is one of the sample. None if there is no positive or no other text.
    """
    texts = docs.where(F.col("doc_id").isNotNull() & (F.length(whole("text")) > 0)).select("doc_id", F.xxhash64("text").alias("h"), "text")
    ids = written(texts.select("doc_id", "h"), "pu-ids")
    trusted = labels.groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q")).where("q = 1").select("doc_id")
    every = written(ids.groupBy("h").agg(F.min("doc_id").alias("doc_id")), "pu-texts")
    good = written(ids.join(trusted, "doc_id", "left_semi").groupBy("h").agg(F.min("doc_id").alias("doc_id")), "pu-positives")
    # At most 2 * sample rows of two numbers.
    chosen = written(_first(every, sample).withColumn("positive", F.lit(False)).unionByName(_first(good, sample).withColumn("positive", F.lit(True))), "pu-sample")
    found = texts.join(F.broadcast(chosen), ["doc_id", "h"]).select("positive", "h", F.col("text").cast("binary").alias("_t"))
    rows = found.mapInArrow(_measured(2), "positive boolean, h long, counts array<double>").groupBy("positive", "h").agg(F.first("counts").alias("counts")).collect()
    rows.sort(key=lambda r: r.h)
    sides = [features(np.array([r.counts for r in rows if r.positive is side]).reshape(-1, _COUNTS)) for side in (True, False)]
    return learn(*sides) if all(map(len, sides)) else None


def _scored(model: Model | None, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                scores = model.net.score(features(np.stack([counts(t.as_py()) for t in batch.column("_t")])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(scores)], [*batch.schema.names[:keep], "score"])
    return run


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs` with score (0 to 1) and predicted (1 from THRESHOLD on).

    Null text counts as empty; an empty text has the score of zero features. Without a model every score is 0.5. Equal texts
    get equal scores; rows are kept as they come, repeated ones too. Columns of `keep` named score or predicted are replaced.
    """
    carried = Carried(docs.select(*keep), ("score", "predicted"))
    frame = docs.select(*carried.inside(), whole("text").cast("binary").alias("_t"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema[:-1]), "score double"])
    made = frame.mapInArrow(_scored(model, len(frame.columns) - 1), schema)
    return made.select(*carried.outside(), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
