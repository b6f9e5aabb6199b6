"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, encoding.

A stage decides row by row and keeps all columns of ``documents``; the last one
returns what the encoder does.  Nulls, empty texts, ties and repeated rows are
decided as the operators' docstrings say; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, exact_dedup, mixing, ngram_join, quality
from sparkloom.llm.registry import table, vocabulary
from sparkloom.llm.scratch import drop, new_path, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; repeated rows fare alike."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: that of the smallest id, a null id last; of repeated rows any one."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents one row stays: that of the smallest id, a null id last; texts without words all stay."""
    return ngram_join.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their cell's probability; null values are a cell's value like others, equal ids are drawn alike."""
    return mixing.sample(docs, mixing.TARGETS, mixing.production_dims())


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document: digests of its ids and of their decoding; a null text has no ids."""
    return bpe.encode(docs, vocabulary(), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram join", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encode_stage),
]

#: Near-copy components and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread by the next; a stage's table goes when the next one's is there."""
    docs = table(spark, sf_dir, "documents")
    held = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"pipeline-{k}")
        docs = written(stage(spark, docs, sf_dir), path)
        if held:
            drop(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
