"""Corpus pipeline over ``documents``: five stages, each written as Parquet and reread as the next one's input.

Every stage but the last returns the columns of ``documents``. The quality
classifier drops what it rejects, near-duplicate removal keeps the smallest id of
each group, decontamination drops documents that hold a benchmark passage, PII
sanitising rewrites texts, and packing returns pieces of sequences with their ids.

Defined results: null texts and ids go through all stages (a row without id has no
copies and its pieces have no id); rows that share an id share its fate in the
near-duplicate stage and are each packed; very long texts are worked on whole;
labels and items that are null are not used, repeated ones count once or change
nothing; of equal documents the smallest id stays; other columns of ``documents``
come through all stages but the last as they were, whatever their names; an empty
table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, near_dedup, packing, pii, quality_classifier
from graphloom.llm.common import read, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.drop_rejected(docs, read(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def sanitize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitize(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("pii", sanitize),
    ("packing", pack),
]

#: A trained classifier, LSH and byte-pair ids have no SQL form; tests/llm/test_pipeline.py holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage wrote for itself goes with it
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
