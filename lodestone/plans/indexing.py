"""Building, updating and describing the index of a project."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import config as settings
from lodestone.config import ProjectConfig
from lodestone.errors import NavigationError
from lodestone.functions.text import mask_block
from lodestone.operators.changes import KEY, change_set
from lodestone.operators.parsing import parse_documents
from lodestone.operators.lexicon import with_lexical_columns
from lodestone.operators.ranking import global_position
from lodestone.operators.scopes import clean_tags
from lodestone.plans.search import check_request, requests_frame, route_batch
from lodestone.session import materialize
from lodestone.sources.markdown_dir import discover_all
from lodestone.sources.providers import HashingProvider, ProviderFactory, embed_column
from lodestone.sources.store import NO_SEGMENTS, TABLES, IndexStore, bucket_of

# Regions between these markers are kept out of the index.
MASK_MARKERS = ("<!-- managed:start -->", "<!-- managed:end -->")


@dataclass(frozen=True)
class Summary:
    added: int
    modified: int
    deleted: int
    unchanged: int
    documents: int
    chunks: int


def _columns(name: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in TABLES[name].split(", ") if " " in part.strip()]


def prepare_chunks(
    documents: DataFrame,
    config: ProjectConfig,
    factory: ProviderFactory,
    first_id: int,
    markers: tuple[str, str] = MASK_MARKERS,
) -> DataFrame:
    """Chunks of documents with vectors, terms and lasting ids."""
    masked = documents.withColumn("content", mask_block(F.col("content"), *markers))
    chunks = parse_documents(
        masked.select(
            F.lit(config.project_id).alias("collection_id"),
            *KEY,
            "display_path",
            clean_tags(F.col("tags")).alias("document_tags"),
            "media_type",
            "content",
        ),
        config.chunking.max_chars,
    )
    embedding = embed_column(
        factory, config.embedding, F.col("embedding_text"), config.embedding.document_prefix
    )
    full = with_lexical_columns(chunks.withColumn("embedding", embedding))
    placed = global_position(full, [*KEY, "ordinal"], "position", "chunks")
    numbered = placed.withColumn("chunk_id", F.col("position") + F.lit(first_id))
    return numbered.select(*_columns("chunks"))


def _check_vectors(chunks: DataFrame, store: IndexStore) -> int | None:
    """Common dimension of new vectors; an error when it differs anywhere."""
    size = F.size("embedding")
    found = chunks.agg(
        F.min(size).alias("low"), F.max(size).alias("high"), F.countDistinct(size).alias("n")
    ).first()
    known = store.manifest["metadata"].get("embedding_dimension")
    if found.n > 1 or (found.n and known and int(known) != found.low):
        raise NavigationError(
            "EMBEDDING_DIMENSION_MISMATCH",
            f"Expected {known or 'one'} dimension, got {found.n} from {found.low} to {found.high}.",
        )
    return found.low


def _counts(store: IndexStore) -> tuple[int, int]:
    return store.table("documents").count(), store.table("chunks").count()


def _change_counts(changes: DataFrame) -> dict[str, int]:
    found = {row.change: row["count"] for row in changes.groupBy("change").count().collect()}
    return {name: found.get(name, 0) for name in ("added", "modified", "deleted", "unchanged")}


def index_documents(
    store: IndexStore,
    config: ProjectConfig,
    discovered: DataFrame,
    factory: ProviderFactory = HashingProvider,
) -> Summary:
    """Bring the index in line with the discovered documents."""
    fingerprint = factory(config.embedding).fingerprint
    known = store.manifest["metadata"].get("embedding_fingerprint")
    if known and known != fingerprint:
        raise NavigationError(
            "EMBEDDING_CONFIG_CHANGED", "Embedding settings changed; build the index anew."
        )
    found = materialize(discovered, "discovered")
    stored = store.table("documents")
    changes = materialize(change_set(found, stored), "changes")
    counts = _change_counts(changes)
    moved = changes.filter(F.col("change") != "unchanged")
    touched = [
        row.bucket
        for row in moved.select(bucket_of(store.buckets).alias("bucket")).distinct().collect()
    ]
    metadata = {
        "embedding_fingerprint": fingerprint,
        "last_updated_at": datetime.now(timezone.utc).isoformat(),
    }
    fresh = found.join(moved, KEY, "left_semi")
    chunks = materialize(
        prepare_chunks(fresh, config, factory, store.manifest["next_chunk_id"]), "new-chunks"
    )
    dimension = _check_vectors(chunks, store)
    if dimension:
        metadata["embedding_dimension"] = str(dimension)
    documents = fresh.select(
        F.lit(config.project_id).alias("collection_id"),
        *[c for c in _columns("documents") if c not in ("collection_id", "indexed_at")],
        F.current_timestamp().alias("indexed_at"),
    )
    old = store.table("chunks", touched)
    frames = {
        "documents": store.table("documents", touched)
        .join(moved, KEY, "left_anti")
        .unionByName(documents),
        "chunks": old.join(moved, KEY, "left_anti").unionByName(chunks),
    }
    segments = None
    if touched:
        gone = old.join(moved, KEY, "left_semi")
        left = store.table("chunks").join(moved, KEY, "left_anti")
        segments = store.add_segment(chunks, gone, left.unionByName(chunks))
    sources = [asdict(source) for source in config.sources]
    store.commit(frames, touched, metadata, sources, chunks.count(), segments)
    return Summary(**counts, **dict(zip(("documents", "chunks"), _counts(store), strict=True)))


def initialize(
    spark: SparkSession, start: str, factory: ProviderFactory = HashingProvider
) -> Summary:
    """Build the index of a project from nothing, replacing any older one."""
    root = settings.locate_for_init(start)
    settings.ensure_ignored(root)
    if not os.path.exists(settings.config_path(root)):
        settings.write_config(root, settings.default_config())
    config = settings.read_config(root)
    store = IndexStore(spark, settings.index_path(root))
    # Later versions never reuse a folder, so the old index stays whole until
    # the new manifest is in place.
    store.manifest = {
        **store.manifest,
        "metadata": {},
        "next_chunk_id": 1,
        "parts": {name: {} for name in TABLES},
        **NO_SEGMENTS,
    }
    return index_documents(store, config, discover_all(spark, config, root), factory)


def _open(spark: SparkSession, start: str) -> tuple[str, ProjectConfig, IndexStore]:
    root = settings.locate_project(start)
    return root, settings.read_config(root), IndexStore(spark, settings.index_path(root))


def update(spark: SparkSession, start: str, factory: ProviderFactory = HashingProvider) -> Summary:
    root, config, store = _open(spark, start)
    if not store.exists:
        raise NavigationError("PROJECT_NOT_INITIALIZED", f"{root} has no index yet.")
    return index_documents(store, config, discover_all(spark, config, root), factory)


def status(spark: SparkSession, start: str) -> dict:
    """Pending changes and index size; writes nothing to the index."""
    root = settings.locate_for_init(start)
    ready = os.path.exists(settings.config_path(root))
    store = IndexStore(spark, settings.index_path(root)) if ready else None
    if store is None or not store.exists:
        blank = dict.fromkeys(("added", "modified", "deleted", "unchanged"), 0)
        return {"root": root, "initialized": False, **blank, "documents": 0, "chunks": 0}
    config = settings.read_config(root)
    found = discover_all(spark, config, root).select(*KEY, "content_hash")
    counts = _change_counts(change_set(found, store.table("documents")))
    documents, chunks = _counts(store)
    return {
        "root": root,
        "initialized": True,
        "model": config.embedding.model,
        **counts,
        "documents": documents,
        "chunks": chunks,
        "last_updated_at": store.manifest["metadata"].get("last_updated_at"),
    }


def search_project(
    spark: SparkSession,
    start: str,
    requests: list[dict],
    factory: ProviderFactory = HashingProvider,
    snippets: bool = False,
):
    """Routes of a request batch over a project's index; none over an empty one."""
    for request in requests:
        check_request(request["query"], request.get("top"))
    _, config, store = _open(spark, start)
    if not store.manifest["parts"]["chunks"]:
        return None
    if factory(config.embedding).fingerprint != store.manifest["metadata"]["embedding_fingerprint"]:
        raise NavigationError(
            "EMBEDDING_CONFIG_CHANGED", "Embedding settings changed; build the index anew."
        )
    asked = requests_frame(
        spark, [{"collection_ids": [config.project_id], **request} for request in requests]
    )
    prefix = config.embedding.query_prefix
    asked = asked.withColumn(
        "vector", embed_column(factory, config.embedding, F.col("query"), prefix)
    )
    return route_batch(
        store.passages(),
        asked,
        config.search,
        snippets,
        keep_routes=True,
        inverted=store.inverted(),
    )
