"""Plain substring search of many patterns over stored texts.

Every run of three letters of a text is indexed, once, in lower case. A text that
holds a pattern holds all its runs, so a pattern is looked up by its rarest runs, in
the ranges of ids that hold them all, and what has them is tested on the text itself.
The index is stored in blocks by bucket of the run, like the postings of tokens: a run of
every text is cut in blocks of bounded size, and a search opens asked buckets only.

Texts shorter than a run are indexed as they are. Patterns shorter than a run are found
by the runs that hold them, which are looked up among the different runs.

A few patterns that are asked once need no index: ``scanned`` tests them in one pass.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import collect_bounded, materialize, scratch_root, spread

RUN = 3
RUN_BUCKETS = 64
BLOCK_IDS = 1024
STRIPE = 64
#: A pattern is looked up by so many of its runs, the rarest.
ANCHORS = 4
#: Up to so many different patterns are tested on each text without an index.
SCANNED = 4096

BLOCKS = "run string, block bigint, at array<int>, bucket int"
RUNS = "run string, texts bigint, bucket int"


def folded(text: Column) -> Column:
    """Lower case that does not depend on what stands around a letter."""
    return F.translate(F.lower(text), "ς", "σ")


def runs_of(text: Column) -> Column:
    """The distinct runs of a text in lower case; a shorter text is its own run."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{%d}))" % RUN), F.lit(1))
    return F.when(F.length(text) < RUN, F.array(text)).otherwise(F.array_distinct(found))


def run_bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(RUN_BUCKETS)).cast("int")


class LiteralIndex(NamedTuple):
    """Stored blocks of runs, how many texts hold each run, and the texts (``id, text``)."""

    blocks: DataFrame
    runs: DataFrame
    texts: DataFrame


def index_runs(texts: DataFrame) -> LiteralIndex:
    """The index of ``id, text`` (whole numbers, each of one text), written to the shared folder.

    Null and empty texts hold nothing.
    """
    spark = texts.sparkSession
    folder = os.path.join(scratch_root(spark), "lodestone", f"runs-{uuid.uuid4().hex}")
    usable = spread(texts.select("id", "text").where("text <> ''"), "id")
    lowered = usable.select("id", folded(F.col("text")).alias("low"))
    rows = lowered.select(
        F.expr(f"(id - pmod(id, {BLOCK_IDS})) div {BLOCK_IDS}").alias("block"),
        F.expr(f"cast(pmod(id, {BLOCK_IDS}) as int)").alias("at"),
        F.explode(runs_of(F.col("low"))).alias("run"),
    )
    dealt = rows.select(
        run_bucket(F.col("run")).alias("bucket"), F.expr(f"block div {STRIPE}").alias("stripe"), *rows.columns
    ).repartition("bucket", "stripe")
    blocks = dealt.groupBy("bucket", "stripe", "run", "block").agg(F.array_sort(F.collect_set("at")).alias("at"))
    blocks.drop("stripe").sortWithinPartitions("bucket", "run", "block").write.partitionBy("bucket").parquet(
        os.path.join(folder, "blocks")
    )
    stored = spark.read.schema(BLOCKS).parquet(os.path.join(folder, "blocks"))
    counted = stored.groupBy("bucket", "run").agg(F.sum(F.size("at")).alias("texts"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "run").write.partitionBy("bucket").parquet(
        os.path.join(folder, "runs")
    )
    return LiteralIndex(stored, spark.read.schema(RUNS).parquet(os.path.join(folder, "runs")), texts.select("id", "text"))


def _anchors(index: LiteralIndex, patterns: DataFrame) -> DataFrame:
    """``pattern_id, run, asked``: the rarest runs of each pattern whose runs are all held."""
    long = patterns.where(F.length("low") >= RUN)
    asked = long.select("pattern_id", F.explode(runs_of(F.col("low"))).alias("run"))
    buckets = asked.select(run_bucket(F.col("run")).alias("bucket")).distinct().collect()  # at most RUN_BUCKETS
    known = index.runs.where(F.col("bucket").isin(sorted(r.bucket for r in buckets)))
    asked = asked.join(known.select("run", "texts"), "run", "left")
    own = Window.partitionBy("pattern_id")
    rarest = own.orderBy("texts", "run")
    return (
        asked.withColumn("absent", F.max(F.col("texts").isNull()).over(own))
        .where(~F.col("absent"))
        .withColumn("nth", F.row_number().over(rarest))
        .where(F.col("nth") <= ANCHORS)
        .withColumn("asked", F.max("nth").over(own))
        .select("pattern_id", "run", "asked")
    )


def _candidates(index: LiteralIndex, anchors: DataFrame) -> DataFrame:
    """``pattern_id, id`` of texts that hold all anchors of a pattern."""
    buckets = anchors.select(run_bucket(F.col("run")).alias("bucket")).distinct().collect()  # at most RUN_BUCKETS
    blocks = index.blocks.where(F.col("bucket").isin(sorted(r.bucket for r in buckets)))
    found = blocks.join(anchors, "run").groupBy("pattern_id", "asked", "block").agg(F.collect_list("at").alias("lists"))
    whole = found.where(F.size("lists") == F.col("asked"))
    rest = F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(0)))
    shared = F.aggregate(rest, F.get("lists", F.lit(0)), F.array_intersect)
    at = whole.select("pattern_id", "block", F.explode(shared).alias("at"))
    return at.select("pattern_id", (F.col("block") * BLOCK_IDS + F.col("at")).alias("id"))


def _short_candidates(index: LiteralIndex, short: DataFrame) -> DataFrame:
    """``pattern_id, id`` of texts with a run that holds a pattern shorter than a run."""
    parts = F.array_distinct(
        F.flatten(
            F.array(
                *[
                    F.regexp_extract_all("run", F.lit(r"(?s)(?=(.{%d}))" % n), F.lit(1))
                    for n in range(1, RUN)
                ]
            )
        )
    )
    holding = index.runs.select("run", F.explode(parts).alias("low")).join(short, "low")
    found = index.blocks.join(holding.select("run", "pattern_id"), "run")
    ids = found.select("pattern_id", "block", F.explode("at").alias("at"))
    return ids.select("pattern_id", (F.col("block") * BLOCK_IDS + F.col("at")).alias("id")).distinct()


def containing(index: LiteralIndex, patterns: DataFrame, any_case: bool = False) -> DataFrame:
    """``pattern_id, id`` of every text that holds a pattern, each pair once.

    ``patterns`` holds ``pattern_id`` (whole number) and ``pattern``; null and empty ones
    are found nowhere. ``any_case`` compares in lower case.
    """
    usable = patterns.where("pattern <> ''").select("pattern_id", "pattern")
    stored = materialize(usable.withColumn("low", folded(F.col("pattern"))), "patterns")
    anchors = materialize(_anchors(index, stored), "pattern-anchors")
    candidates = _candidates(index, anchors)
    short = stored.where(F.length("low") < RUN).select("pattern_id", "low")
    if not short.isEmpty():
        candidates = candidates.unionByName(_short_candidates(index, short))
    # Written, so that the planner knows how few texts are wanted.
    candidates = materialize(candidates, "literal-candidates")
    tested = candidates.join(stored, "pattern_id").join(index.texts, "id")
    holds = F.contains(F.lower("text"), F.lower("pattern")) if any_case else F.contains("text", "pattern")
    return tested.where(holds).select("pattern_id", "id").distinct()


def _byte_runs(text: bytes) -> np.ndarray:
    """Every run of three bytes as a number."""
    a = np.frombuffer(text, dtype=np.uint8).astype(np.int32)
    return (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]


def _holding(patterns: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id`` and the numbers of the patterns that its text holds: all their runs first, then themselves."""
    short = [one for one in patterns.value if len(one[1]) < RUN]
    long = [one for one in patterns.value if len(one[1]) >= RUN]
    runs = [np.unique(_byte_runs(pattern)) for _, pattern in long]
    wanted = np.concatenate(runs) if runs else np.empty(0, dtype=np.int32)
    starts = np.cumsum([0, *map(len, runs)])[:-1]
    present = np.zeros(1 << 24, dtype=bool)
    for batch in batches:
        held = []
        for text in batch.column("text").to_pylist():
            asked = short
            if long and len(text) >= RUN:
                own = _byte_runs(text)
                present[own] = True
                whole = np.logical_and.reduceat(present[wanted], starts)
                present[own] = False
                asked = short + [long[i] for i in np.flatnonzero(whole)]
            held.append([n for n, pattern in asked if pattern in text])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held, pa.list_(pa.int64()))], ["id", "held"])


def scanned(texts: DataFrame, patterns: DataFrame, any_case: bool = False) -> DataFrame:
    """What ``containing`` finds in ``texts`` (``id, text``), without an index where patterns are few.

    Up to ``SCANNED`` different patterns go to the tasks, which test them on each text; more
    are looked up in an index.
    """
    pattern = F.lower("pattern") if any_case else F.col("pattern")
    asked = patterns.where("pattern <> ''").select("pattern_id", pattern.cast("binary").alias("_pattern"))
    grouped = asked.groupBy("_pattern").agg(F.collect_set("pattern_id").alias("owners"))
    stored = materialize(grouped.withColumn("_row", F.monotonically_increasing_id()), "patterns")
    listed = collect_bounded(stored.select("_row", "_pattern"), SCANNED)
    if listed is None:
        return containing(index_runs(texts), patterns, any_case)
    shared = texts.sparkSession.sparkContext.broadcast([(row._row, bytes(row._pattern)) for row in listed])
    text = F.lower("text") if any_case else F.col("text")
    rows = spread(texts.select("id", "text").where("id is not null and text <> ''"), "id")
    rows = rows.select("id", text.cast("binary").alias("text"))
    found = rows.mapInArrow(lambda batches: _holding(shared, batches), "id bigint, held array<bigint>")
    pairs = found.select("id", F.explode("held").alias("_row")).join(F.broadcast(stored), "_row")
    return pairs.select(F.explode("owners").alias("pattern_id"), "id").distinct()
