"""Queries of the operators over the base tables: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import centroids, decontam, extract, langid, lm, mixing, neardup, pii, puquality, quality, search, secrets, sentences
from riskloom.llm.twins import sql_texts  # noqa: F401
from riskloom.sources.tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def _query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _joined(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


@_query
def op1_secret_scan(t: Tables) -> DataFrame:
    return secrets.scan(t("documents")).select(
        "doc_id", *[_count("base", k).alias(f"n_{k}") for k in secrets.BASE], _digest(_joined("base")).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_linked"))


@_query
def op2_language(t: Tables) -> DataFrame:
    docs = t("documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    model = langid.fit(docs.where(~F.col("held_out")).select("text", "lang"))
    return langid.identify(docs, model, ["doc_id", "held_out"])


@_query
def op3_language_model(t: Tables) -> DataFrame:
    return lm.score(t("documents"))


@_query
def op4_personal_data(t: Tables) -> DataFrame:
    """Base spans lead the operator's list, ordered by kind and start."""
    found = pii.find(t("documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id", *[_count("pii", k).alias(f"n_{k}") for k in pii.BASE], _digest(_joined(base)).alias("base_sha256"),
        _joined("pii").alias("spans"), F.round(F.array_max(F.transform("pii", lambda x: x["score"])), 3).alias("max_score"))


@_query
def op5_main_text(t: Tables) -> DataFrame:
    return extract.extract(t("pages"), ["page_id", "url"])


@_query
def op6_source_mix(t: Tables) -> DataFrame:
    return mixing.mix(t("documents"), carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op7_quality_rules(t: Tables) -> DataFrame:
    return quality.measure(t("documents").select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words")


@_query
def op8_near_duplicates(t: Tables) -> DataFrame:
    return neardup.classes(t("documents")).select("doc_id", "n_shingles", "component_id", "kept")


@_query
def op9_repeated_sentences(t: Tables) -> DataFrame:
    return sentences.dedup(t("documents"))


@_query
def op10_decontamination(t: Tables) -> DataFrame:
    return decontam.mark(t("documents"), t("benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        _digest(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated")


@_query
def op11_quality_classifier(t: Tables) -> DataFrame:
    docs = t("documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 5, 0))
    model = puquality.fit(docs.where(~F.col("held_out")), t("labels"))
    return puquality.score(docs, model, ["doc_id", "held_out"])


@_query
def op12_ranked_search(t: Tables) -> DataFrame:
    return search.search(t("documents"), t("benchmark"))


@_query
def op13_centroids(t: Tables) -> DataFrame:
    return centroids.cluster(t("embeddings"))
