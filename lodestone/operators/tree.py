"""Aggregating results along their path and heading hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import display_heading, path_segments

SCORE_UNIT = 10_000


def _folders(segments: Column) -> Column:
    return F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))


def common_directory(results: DataFrame, group: str = "qid") -> DataFrame:
    """Longest directory prefix shared by all results of a group.

    The prefix shared by all equals the one shared by the smallest and the
    largest directory, so two mergeable aggregates are enough.
    """
    folders = results.select(group, _folders(path_segments(F.col("display_path"))).alias("_dir"))
    ends = folders.groupBy(group).agg(F.min("_dir").alias("_low"), F.max("_dir").alias("_high"))
    differs = F.filter(
        F.sequence(F.lit(1), F.least(F.size("_low"), F.size("_high")) + 1),
        lambda i: ~F.get(F.col("_low"), i - 1).eqNullSafe(F.get(F.col("_high"), i - 1))
        | F.get(F.col("_low"), i - 1).isNull(),
    )
    length = F.get(differs, F.lit(0)) - 1
    return ends.select(group, F.slice("_low", F.lit(1), length).alias("common"))


def tree_leaves(results: DataFrame, group: str = "qid") -> DataFrame:
    """One row per distinct line range with its node path; the best score stays.

    Scores are whole numbers of 1/10000: results are rounded to four places.
    """
    shared = common_directory(results, group)
    segments = path_segments(F.col("display_path"))
    name = F.element_at(segments, -1)

    def labelled(labels: Column, kind: str) -> Column:
        return F.transform(
            labels, lambda label: F.struct(F.lit(kind).alias("kind"), label.alias("label"))
        )

    below = F.slice(
        segments,
        F.size("common") + 1,
        F.greatest(F.size(segments) - 1 - F.size("common"), F.lit(0)),
    )
    path = F.concat(
        labelled(below, "directory"),
        labelled(F.array(name), "file"),
        labelled(display_heading(name, F.col("heading")), "heading"),
    )
    units = F.round(F.col("score") * SCORE_UNIT).cast("bigint")
    return (
        results.join(shared, group)
        .select(group, path.alias("node"), "start_line", "end_line", units.alias("units"))
        .groupBy(group, "node", "start_line", "end_line")
        .agg(F.max("units").alias("units"))
    )


def tree_nodes(results: DataFrame, group: str = "qid") -> DataFrame:
    """Leaf count, mean and best score of every directory, file and heading."""
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("node")), lambda n: F.slice(F.col("node"), F.lit(1), n)
    )
    exploded = tree_leaves(results, group).select(
        group, F.explode(prefixes).alias("node"), "units"
    )
    return exploded.groupBy(group, "node").agg(
        F.count("*").alias("leaves"),
        (F.sum("units") / F.count("*") / SCORE_UNIT).alias("average"),
        (F.max("units") / SCORE_UNIT).alias("maximum"),
    )


def natural_key(label: Column) -> Column:
    """Label with each number led by its length, so that ``2`` sorts before ``10``."""
    parts = F.regexp_extract_all(label, F.lit(r"(\d+|\D+)"), F.lit(1))

    def led(part: Column) -> Column:
        plain = F.regexp_replace(part, r"^0+(?=\d)", "")
        length = F.lpad(F.length(plain).cast("string"), 10, "0")  # of any string's length
        return F.when(part.rlike(r"^\d"), F.concat(length, plain)).otherwise(part)

    return F.array_join(F.transform(parts, led), "")


def ordered_nodes(nodes: DataFrame, group: str = "qid") -> DataFrame:
    """Number siblings by best score, mean, leaf count and label."""
    last = F.element_at("node", -1)
    siblings = Window.partitionBy(
        group, F.slice("node", F.lit(1), F.size("node") - 1)
    ).orderBy(
        F.desc("maximum"),
        F.desc("average"),
        F.desc("leaves"),
        F.collate(natural_key(last["label"]), "zh").asc(),
        last["label"].asc(),
        last["kind"].asc(),
    )
    return nodes.withColumn("place", F.row_number().over(siblings))
