"""Per-request filters, applied to passages before anything is ranked.

The filters of a batch are a table. They meet passages by joins: collections, sources
and tags through the few combinations that passages have of them, paths through an
index of their runs of letters. Each passage gets the numbers of the filters it
satisfies, in one pass for any number of filters.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import path_needle
from lodestone.operators.literal import containing, index_runs
from lodestone.operators.ranking import global_position
from lodestone.session import collect_bounded, materialize

KINDS = ("_path", "_collections", "_sources", "_tags")
GROUP = ("_collection", "_source", "_tag_list")
#: Up to so many paths are tested on each passage's path, more are looked up by their runs.
FEW_PATHS = 32


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _lowered(tags: Column) -> Column:
    return F.transform(F.coalesce(tags, _no_names()), lambda tag: F.lower(tag))


def path_contains(display_path: Column, wanted: Column) -> Column:
    slashes = F.lower(F.replace(display_path, F.lit("\\"), F.lit("/")))
    return F.contains(slashes, path_needle(wanted))


def tags_match(document_tags: Column, source_tags: Column, wanted: Sequence[str]) -> Column:
    """Any wanted tag on the document or on its source, whatever the case."""
    both = F.array_union(_lowered(document_tags), _lowered(source_tags))
    return F.arrays_overlap(both, F.array(*[F.lit(tag.lower()) for tag in wanted]))


def clean_tags(tags: Column) -> Column:
    """Trimmed, non-blank tags without repeats; the first spelling stays."""
    kept = F.filter(F.transform(tags, lambda tag: F.trim(tag)), lambda tag: tag != "")
    lowered = F.transform(kept, lambda tag: F.lower(tag))
    return F.filter(kept, lambda tag, i: F.array_position(lowered, F.lower(tag)) == i + 1)


def scope_condition(
    path: str | None = None,
    collection_ids: Sequence[str] | None = None,
    source_ids: Sequence[str] | None = None,
    tags: Sequence[str] | None = None,
) -> Column | None:
    """All active filters of one request as one predicate; ``None`` without any."""
    active = []
    if path:
        active.append(path_contains(F.col("display_path"), F.lit(path)))
    if collection_ids:
        active.append(F.col("collection_id").isin(list(collection_ids)))
    if source_ids:
        active.append(F.col("source_id").isin(list(source_ids)))
    if tags:
        active.append(tags_match(F.col("document_tags"), F.col("source_tags"), tags))
    return reduce(lambda left, right: left & right, active) if active else None


# ---- the filters of a batch, as data ----


def _asked(queries: DataFrame) -> DataFrame:
    """``queries`` with ``_path`` and sorted ``_collections, _sources, _tags``; null where inactive."""

    def names(column: str, lower: bool = False) -> Column:
        if column not in queries.columns:
            return F.lit(None).cast("array<string>")
        wanted = _lowered(F.col(column)) if lower else F.coalesce(column, _no_names())
        wanted = F.array_sort(F.array_distinct(wanted))
        return F.when(F.size(wanted) > 0, wanted)

    path = path_needle(F.col("path")) if "path" in queries.columns else F.lit(None).cast("string")
    return queries.select(
        "*",
        F.when(path != "", path).alias("_path"),
        names("collection_ids").alias("_collections"),
        names("source_ids").alias("_sources"),
        names("tags", lower=True).alias("_tags"),
    )


class Scopes(NamedTuple):
    """The different filters of a batch: ``scope`` numbers from 0, and each request's.

    ``table`` is none where no request has a filter.
    """

    requests: DataFrame
    table: DataFrame | None


def number_scopes(queries: DataFrame) -> Scopes:
    """Add each request's ``scope``; the filters stay in Spark, however many there are."""
    asked = _asked(queries).withColumn("_key", F.to_json(F.struct(*KINDS)))
    distinct = asked.select("_key", *KINDS).distinct()
    table = global_position(distinct, ["_key"], "scope", "scopes").withColumn("scope", F.col("scope").cast("int"))
    if table.where(" or ".join(f"{kind} is not null" for kind in KINDS)).isEmpty():
        return Scopes(queries.withColumn("scope", F.lit(0)), None)
    numbered = asked.join(table.select("_key", "scope"), "_key").select(*queries.columns, "scope")
    return Scopes(numbered, table)


def _without(table: DataFrame, kind: str) -> Column:
    """The scopes that do not filter by a kind, in one array."""
    return table.agg(F.collect_set(F.when(F.col(kind).isNull(), F.col("scope"))).alias("free")).scalar()


def _naming(table: DataFrame, kind: str) -> DataFrame:
    """``_value`` and the scopes that name it."""
    named = table.select("scope", F.explode(kind).alias("_value"))
    return named.groupBy("_value").agg(F.collect_set("scope").alias("_named"))


def _groups(passages: DataFrame, table: DataFrame) -> DataFrame:
    """Collections, sources and tags of passages, with the scopes each combination satisfies.

    ``_whole`` are those without a path, ``_pathed`` those that ask for one as well. Passages
    share few combinations, so filters are joined with these and not with passages.
    """
    kept = passages.select(*GROUP).distinct().withColumn("_group", F.xxhash64(*GROUP))
    kept = materialize(kept, "scope-groups")
    none = F.array().cast("array<int>")
    found = kept
    for kind, column in (("_collections", "_collection"), ("_sources", "_source")):
        named = _naming(table, kind).withColumnRenamed("_named", f"{column}_scopes")
        found = found.join(named, found[column] == named["_value"], "left").drop("_value")
    tags = kept.select("_group", F.explode("_tag_list").alias("_value")).join(_naming(table, "_tags"), "_value")
    tags = tags.groupBy("_group").agg(F.array_distinct(F.flatten(F.collect_list("_named"))).alias("_tag_scopes"))
    found = found.join(tags, "_group", "left")
    satisfied = None
    for kind, column in (("_collections", "_collection_scopes"), ("_sources", "_source_scopes"), ("_tags", "_tag_scopes")):
        fitting = F.array_union(F.coalesce(column, none), _without(table, kind))
        satisfied = fitting if satisfied is None else F.array_intersect(satisfied, fitting)
    found = found.select(*GROUP, satisfied.alias("_fit"))
    free = _without(table, "_path")
    return found.select(
        *GROUP, F.array_intersect("_fit", free).alias("_whole"), F.array_except("_fit", free).alias("_pathed")
    )


def _on_paths(passages: DataFrame, table: DataFrame) -> DataFrame:
    """``chunk_id`` and the scopes whose path it holds: a few by themselves, many by an index of runs."""
    wanted = table.where("_path is not null").select("_path", "scope")
    paths = passages.select("chunk_id", F.lower(F.replace("display_path", F.lit("\\"), F.lit("/"))).alias("text"))
    few = collect_bounded(wanted, FEW_PATHS)
    if few is not None:
        hits = [F.when(F.contains("text", F.lit(row._path)), F.lit(row.scope)) for row in few]
        found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")
        return paths.select("chunk_id", found.alias("_on_path"))
    needles = wanted.groupBy("_path").agg(F.collect_set("scope").alias("_named"), F.min("scope").alias("pattern_id"))
    needles = materialize(needles, "path-needles")
    index = index_runs(paths.withColumnRenamed("chunk_id", "id"))
    held = containing(index, needles.select("pattern_id", F.col("_path").alias("pattern")))
    named = held.join(needles.select("pattern_id", "_named"), "pattern_id")
    return named.groupBy(F.col("id").alias("chunk_id")).agg(F.flatten(F.collect_list("_named")).alias("_on_path"))


def with_scopes(passages: DataFrame, table: DataFrame | None) -> DataFrame:
    """Add to each passage the array of ``scopes`` it satisfies."""
    if table is None:
        return passages.withColumn("scopes", F.array(F.lit(0)))
    tags = F.array_sort(F.array_union(_lowered(F.col("document_tags")), _lowered(F.col("source_tags"))))
    told = passages.select(
        "*",
        F.coalesce("collection_id", F.lit("")).alias("_collection"),
        F.coalesce("source_id", F.lit("")).alias("_source"),
        tags.alias("_tag_list"),
    )
    joined = told.join(_groups(told, table), list(GROUP), "left")
    none = F.array().cast("array<int>")
    whole, pathed = (F.coalesce(c, none) for c in ("_whole", "_pathed"))
    if table.where("_path is not null").isEmpty():
        return joined.select(*passages.columns, whole.alias("scopes"))
    joined = joined.join(_on_paths(passages, table), "chunk_id", "left")
    on_path = F.array_intersect(pathed, F.coalesce("_on_path", none))
    return joined.select(*passages.columns, F.concat(whole, on_path).alias("scopes"))
