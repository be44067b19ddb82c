"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from pageloom.llm.shared import table, written


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.survivors(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.filtered(docs, table(spark, sf_dir, "benchmark"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality rules", _quality_rules),
    ("line dedup", _line_dedup),
    ("near duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("packing", _packing),
]
ORACLE_SQL = None  # tokens can't be made in SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
