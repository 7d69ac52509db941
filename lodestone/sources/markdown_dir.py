"""Markdown files of a folder as rows, listed and read by the executors.

Folders are listed level by level in tasks, so neither names nor contents pass
through the driver.  Hidden files count and links are not followed, which the
built-in file listing cannot offer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import ProjectConfig, SourceConfig
from lodestone.session import materialize

_LISTED = "path string, relative string, folder boolean"
_READ = "relative string, absolute_path string, content string, modified_at_ms double, size_bytes bigint"


def glob_pattern(glob: str) -> str:
    """Regular expression for a path glob with ``**``, ``*``, ``?``, ``[]``, ``{}``."""
    pieces, at, depth = [], 0, 0
    while at < len(glob):
        char = glob[at]
        if glob.startswith("**/", at):
            pieces.append("(?:[^/]+/)*")
            at += 3
            continue
        if glob.startswith("**", at):
            pieces.append(".*")
            at += 2
            continue
        close = glob.find("]", at + 1) if char == "[" else -1
        if close > at:
            inner = glob[at + 1 : close]
            pieces.append("[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]")
            at = close
        elif char == "{":
            depth += 1
            pieces.append("(?:")
        elif char == "}" and depth:
            depth -= 1
            pieces.append(")")
        elif char == "," and depth:
            pieces.append("|")
        else:
            pieces.append({"*": "[^/]*", "?": "[^/]"}.get(char, re.escape(char)))
        at += 1
    return "".join(pieces)


def _matcher(globs: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{glob_pattern(g)})" for g in globs) or r"(?!)")


def _lister(skipped: re.Pattern) -> Callable:
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, relative in zip(batch["path"], batch["relative"], strict=True):
                with os.scandir(path) as entries:
                    for entry in entries:
                        name = f"{relative}{entry.name}"
                        if entry.is_dir(follow_symlinks=False):
                            if not skipped.fullmatch(f"{name}/\0"):
                                rows.append((entry.path, f"{name}/", True))
                        elif entry.is_file(follow_symlinks=False):
                            rows.append((entry.path, name, False))
            yield pd.DataFrame(rows, columns=["path", "relative", "folder"])

    return listed


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, relative in zip(batch["path"], batch["relative"], strict=True):
            facts = os.stat(path)
            content = Path(path).read_bytes().decode("utf-8", "replace")
            rows.append((relative, path, content, facts.st_mtime_ns / 1e6, facts.st_size))
        yield pd.DataFrame(
            rows, columns=["relative", "absolute_path", "content", "modified_at_ms", "size_bytes"]
        )


def matching_files(spark: SparkSession, source: SourceConfig, root: str) -> DataFrame:
    """``path, relative`` of the files a source includes."""
    lister = _lister(_matcher(tuple(g for g in source.exclude if g.endswith("/**"))))
    level = spark.createDataFrame([(root, "", True)], _LISTED)
    files = []
    while True:
        found = materialize(level.mapInPandas(lister, _LISTED), "listing")
        files.append(found.filter(~F.col("folder")))
        folders = found.filter("folder")
        if folders.isEmpty():
            break
        level = folders.repartition(spark.sparkContext.defaultParallelism, "path")
    included = "^(?:" + "|".join(glob_pattern(g) for g in source.include) + r")\z"
    kept = reduce(DataFrame.unionByName, files).filter(F.col("relative").rlike(included))
    if source.exclude:
        excluded = "^(?:" + "|".join(glob_pattern(g) for g in source.exclude) + r")\z"
        kept = kept.filter(~F.col("relative").rlike(excluded))
    return kept.select("path", "relative")


def discover(spark: SparkSession, source: SourceConfig, project_root: str) -> DataFrame:
    """One row per included file of one source."""
    project = os.path.abspath(project_root)
    root = os.path.normpath(os.path.join(project, source.path))
    spread_files = matching_files(spark, source, root).repartition(
        spark.sparkContext.defaultParallelism, "path"
    )
    rows = spread_files.mapInPandas(_read, _READ)
    inside = os.path.relpath(root, project)
    if inside == "..":
        prefix = f"{source.id}/"
    elif inside.startswith("../"):
        prefix = f"{source.id}/"
    else:
        prefix = "" if inside == "." else f"{inside}/"
    return rows.select(
        F.lit(source.id).alias("source_id"),
        F.col("relative").alias("document_key"),
        F.concat(F.lit("file://"), "absolute_path").alias("locator"),
        F.concat(F.lit(prefix), "relative").alias("display_path"),
        F.lit("text/markdown").alias("media_type"),
        "content",
        F.sha2("content", 256).alias("content_hash"),
        "modified_at_ms",
        "size_bytes",
        F.array().cast("array<string>").alias("tags"),
    )


SOURCES: dict[str, Callable[[SparkSession, SourceConfig, str], DataFrame]] = {
    "markdown-directory": discover
}


def discover_all(spark: SparkSession, config: ProjectConfig, project_root: str) -> DataFrame:
    """Documents of every configured source."""
    found = [SOURCES[source.kind](spark, source, project_root) for source in config.sources]
    return reduce(DataFrame.unionByName, found)
