"""Comparing document snapshots, and applying the difference to an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["source_id", "document_key"]


def change_set(discovered: DataFrame, indexed: DataFrame) -> DataFrame:
    """``source_id, document_key, change`` for every document on either side."""
    new = discovered.select(*KEY, F.col("content_hash").alias("_new"))
    old = indexed.select(*KEY, F.col("content_hash").alias("_old"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "deleted")
        .when(F.col("_new") != F.col("_old"), "modified")
        .otherwise("unchanged")
    )
    return new.join(old, KEY, "full_outer").select(*KEY, change.alias("change"))


def change_counts(changes: DataFrame) -> DataFrame:
    kinds = ("added", "modified", "deleted", "unchanged")
    return changes.agg(*[F.count_if(F.col("change") == kind).alias(kind) for kind in kinds])


def deleted_documents(discovered: DataFrame, indexed: DataFrame) -> DataFrame:
    return indexed.join(discovered.select(*KEY), KEY, "left_anti")


def apply_changes(stored: DataFrame, discovered: DataFrame) -> DataFrame:
    """Stored documents after an update: unchanged rows stay as they were."""
    incoming = discovered.select(*KEY, F.col("content_hash").alias("_new"))
    same = stored.content_hash == F.col("_new")
    kept = stored.join(incoming, KEY).filter(same).select(*stored.columns)
    known = stored.select(*KEY, "content_hash")
    fresh = discovered.join(known, [*KEY, "content_hash"], "left_anti").select(*stored.columns)
    return kept.unionByName(fresh)


def keep_listed_sources(rows: DataFrame, configured: DataFrame) -> DataFrame:
    """The same with the configured ``collection_id, source_id`` as a frame."""
    return rows.join(configured, ["collection_id", "source_id"], "left_semi")


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert new rows and overwrite the columns that ``incoming`` carries."""
    key = list(key)
    values = [name for name in stored.columns if name not in key]
    renamed = incoming.select(
        *key, *[F.col(n).alias(f"_new_{n}") for n in values if n in incoming.columns],
        F.lit(True).alias("_here"),
    )
    merged = stored.join(renamed, key, "full_outer")

    def value(name: str):
        if name not in incoming.columns:
            return F.col(name)
        return F.when(F.col("_here"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    return merged.select(*key, *[value(name) for name in values])


def index_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks per collection."""
    owned = chunks.groupBy(*KEY).agg(F.count("*").alias("_chunks"))
    return (
        documents.join(owned, KEY, "left")
        .groupBy("collection_id")
        .agg(
            F.count("*").alias("documents"),
            F.coalesce(F.sum("_chunks"), F.lit(0)).alias("chunks"),
        )
    )
