"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, size: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``size`` documents, half of each label.

    Ids are taken in the order of their hash, only rows that are not held out.
    The chosen ids are at most ``size`` rows, so they are broadcast to the texts. Of several
    rows of one id the smallest text counts, so the bound is one of rows too.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    parts = [
        known.where(F.col(target) == label)
        .select("doc_id", F.lit(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(size // 2)
        for label in (0, 1)
    ]
    chosen = parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
