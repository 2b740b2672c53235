"""Classifiers on feature tables with pyspark.ml, and models hosted in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.reference import checked_rows


def forest(features: Sequence[str], label: str, weight: str | None = None, trees: int = 20, depth: int = 6, seed: int = 42) -> Pipeline:
    """Assembled and scaled features into a random forest with row weights."""
    model = RandomForestClassifier(featuresCol="scaled", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), model])


def feature_importance(model: PipelineModel, features: Sequence[str], n: int = 10) -> DataFrame:
    """The n features a forest relies on most."""
    last = model.stages[-1]
    pairs = sorted(zip(features, last.featureImportances.toArray()), key=lambda p: (-p[1], p[0]))[:n]
    return SparkSession.active().createDataFrame([(i + 1, f, float(v)) for i, (f, v) in enumerate(pairs)], "rank int, feature string, importance double")


def cross_validated(pipeline: Pipeline, rows: DataFrame, label: str, folds: int = 5, seed: int = 42) -> float:
    """Mean accuracy over the folds."""
    check = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    run = CrossValidator(estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), evaluator=check, numFolds=folds, seed=seed)
    return float(run.fit(rows).avgMetrics[0])


def text_classifier(text: str, label: str, buckets: int = 1 << 14, rounds: int = 20) -> Pipeline:
    """Hashed word counts with inverse document frequency into logistic regression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=buckets), IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(labelCol=label, maxIter=rounds)])


def score_rows(model: PipelineModel, rows: DataFrame, valid: Column) -> DataFrame:
    """Predictions for valid rows; the others stay with status 'error' and no prediction."""
    good = model.transform(rows.filter(valid)).select(*rows.columns, "prediction", F.lit("ok").alias("status"))
    bad = rows.filter(~F.coalesce(valid, F.lit(False))).select(
        "*", F.lit(None).cast("double").alias("prediction"), F.lit("error").alias("status"))
    return good.unionByName(bad)


#: Texts given to a model at once.
BATCH = 64


def score_batches(rows: DataFrame, keep: Sequence[str], text: str, load: Callable[[], Callable], labels: Sequence[str], safe: str,
                  sure: float = 0.8, size: int = BATCH) -> DataFrame:
    """Columns `keep` with prediction, confidence, probabilities (map), is_safe, requires_review, status and error.

    `load` runs once a task and returns the model: an Arrow array of texts to a table of probabilities, one column a label.
    A batch that fails is tried text by text; a text that fails by itself, and a null text, stay as a row with prediction
    ERROR, confidence 0, status 'error' and the reason. A prediction other than `safe` below `sure` needs review.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    probabilities = pa.map_(pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = load() if model is None else model
            texts = batch.column(len(keep))
            given = np.flatnonzero(np.asarray(texts.is_valid()))
            shares, errors = np.full((batch.num_rows, len(labels)), np.nan), ["no text"] * batch.num_rows

            def attempt(at: np.ndarray) -> None:
                try:
                    shares[at] = model(texts.take(pa.array(at)))
                    for i in at:
                        errors[i] = None
                except Exception as problem:  # any failure of a hosted model becomes a row's status
                    if len(at) == 1:
                        errors[at[0]] = f"{type(problem).__name__}: {problem}"
                    else:
                        for i in at:
                            attempt(np.array([i]))

            for k in range(0, len(given), size):
                attempt(given[k:k + size])
            good = np.array([e is None for e in errors], dtype=bool)
            best = np.where(good, np.nan_to_num(shares, nan=-1.0).argmax(axis=1), 0)
            sureness = np.where(good, shares[np.arange(len(best)), best], 0.0)
            name = [labels[b] if ok else "ERROR" for b, ok in zip(best, good)]
            is_safe = np.array([n == safe for n in name], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(name, pa.string()), pa.array(sureness),
                 pa.array([list(zip(labels, map(float, s))) if ok else None for s, ok in zip(shares, good)], probabilities),
                 pa.array(is_safe), pa.array(~good | (~is_safe & (sureness < sure))),
                 pa.array(["ok" if ok else "error" for ok in good], pa.string()), pa.array(errors, pa.string())],
                [*batch.schema.names[:len(keep)], "prediction", "confidence", "probabilities", "is_safe", "requires_review", "status", "error"])

    schema = f"{kinds}, prediction string, confidence double, probabilities map<string,double>, is_safe boolean, requires_review boolean, status string, error string"
    return rows.select(*keep, text).mapInArrow(run, schema)


class Discriminant:
    """Linear scores per label over counts of patterns in a text (a share of its length) and its length in thousands."""

    def __init__(self, labels: list[str], patterns: Sequence[str], weights: np.ndarray, offsets: np.ndarray):
        self.labels, self.patterns, self.weights, self.offsets = labels, list(patterns), weights, offsets

    @staticmethod
    def columns(text: str, patterns: Sequence[str]) -> list[Column]:
        """What `measure` gives, as columns."""
        size = F.length(text)
        return [*(F.coalesce(F.try_divide(F.regexp_count(text, F.lit(p)), size), F.lit(0.0)) for p in patterns), size / 1000.0]

    def measure(self, texts: pa.Array) -> np.ndarray:
        size = np.asarray(pc.utf8_length(texts), dtype=np.float64)
        counts = [np.asarray(pc.count_substring_regex(texts, pattern=p), dtype=np.float64) for p in self.patterns]
        return np.column_stack([*(c / np.maximum(size, 1) for c in counts), size / 1000.0])

    def __call__(self, texts: pa.Array) -> np.ndarray:
        scores = self.measure(texts) @ self.weights.T + self.offsets
        shares = np.exp(scores - scores.max(axis=1, keepdims=True))
        return shares / shares.sum(axis=1, keepdims=True)


def fit_discriminant(rows: DataFrame, text: str, label: str, patterns: Sequence[str], most_labels: int = 100) -> Discriminant:
    """The model from one pass of sufficient statistics: count, mean and variance of every measure by label.

    The variances are pooled over the labels; a measure that never varies carries no weight.
    """
    names = [f"x{i}" for i in range(len(patterns) + 1)]
    measured = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).alias("label"), *[c.alias(n) for n, c in zip(names, Discriminant.columns(text, patterns))])
    told = checked_rows(measured.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m_{n}") for n in names], *[F.var_pop(n).alias(f"v_{n}") for n in names]), most_labels)
    told = sorted(told, key=lambda r: r["label"])
    if not told:
        raise ValueError("no labelled text")
    n = np.array([r["n"] for r in told], dtype=np.float64)
    mean = np.array([[r[f"m_{x}"] for x in names] for r in told])
    pooled = (n[:, None] * np.array([[r[f"v_{x}"] for x in names] for r in told])).sum(axis=0) / n.sum()
    precision = np.divide(1.0, pooled, out=np.zeros_like(pooled), where=pooled > 1e-12)
    return Discriminant([r["label"] for r in told], patterns, mean * precision, np.log(n / n.sum()) - 0.5 * (mean * mean * precision).sum(axis=1))
