"""Versions of the stored document table, and reading older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import NavigationError

SCHEMA_VERSION = 2

DOCUMENTS = (
    "collection_id string, source_id string, document_key string, locator string, "
    "display_path string, media_type string, content_hash string, modified_at_ms double, "
    "size_bytes bigint, tags array<string>, indexed_at timestamp"
)

# What each version added: column and the value older rows get.
_ADDED = {2: {"media_type": "text/markdown"}}


def upgraded(documents: DataFrame, version: int) -> DataFrame:
    """Documents stored under ``version`` in the shape of the current one."""
    if version > SCHEMA_VERSION:
        raise NavigationError(
            "INDEX_DATA_INVALID", f"Index version {version} is newer than {SCHEMA_VERSION}."
        )
    for number in range(version + 1, SCHEMA_VERSION + 1):
        for name, value in _ADDED.get(number, {}).items():
            if name not in documents.columns:
                documents = documents.withColumn(name, F.lit(value))
    return documents


def current_version(migrations: DataFrame) -> DataFrame:
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
