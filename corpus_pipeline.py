"""A training corpus from documents: quality, near-duplicates, benchmark passages, personal data, source mix.

Each stage takes (spark, docs, sf_dir). Its result is written as Parquet and read again as the next stage's docs, so a lost
executor costs at most one stage. All stages but the last return the columns of documents.

In every stage equal rows are treated alike and stay as many as they are, an empty table gives an
empty one, texts of any length are read whole, and columns beside those named here pass unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontam, mixing, neardup, pii, quality
from riskloom.session import written
from riskloom.sources.tables import Tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts have too few words and go; a null lang is a language of its own."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; equal rows of one id all stay.

    Texts without words are near nothing and stay."""
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of note. Null and empty texts hold none and stay; items without words mark nothing."""
    return decontam.drop_contaminated(docs, Tables(spark, sf_dir)("benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; n_chars follows the text. A null text stays null."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with their place in it (virtual finish time) and the words taken of each.

    Texts without words give it nothing and are not in it; a null source is a source; ties are in order of doc_id."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("source_mix", source_mix),
]

#: The near-duplicate stage has no SQL that runs at size; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents."""
    docs = Tables(spark, sf_dir)("documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
