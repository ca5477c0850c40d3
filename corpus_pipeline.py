"""From raw documents to a training mix: quality, near-duplicates, benchmark leaks, personal data, source weights.

Every stage takes the documents that the one before kept and returns documents of the same columns, which ``run`` writes as Parquet
and reads again; the last returns the sampled documents' ids with their weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenaflow.llm import decontaminate, mixing, near_dedup, pii, quality
from arenaflow.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on labelled documents of the input) doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    return near_dedup.keep_first(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample whose token weights follow the source, language and topic targets."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", leak_stage),
    ("pii", pii_stage),
    ("mixing", mix_stage),
]

#: SQL can't express the classifier, the sketches and the raking: tests/llm checks every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
