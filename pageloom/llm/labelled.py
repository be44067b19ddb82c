"""A bounded sample of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, out: int, limit: int) -> DataFrame:
    """doc_id, text, label of at most ``limit`` training documents, those first by a hash of doc_id.

    Rows of the fold ``out`` and those without an id or label are never taken. Of several labels for
    a document the largest counts.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & (fold(F.col("doc_id"), parts) != out))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
