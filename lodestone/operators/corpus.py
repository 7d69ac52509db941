"""Corpus-wide figures: size, fingerprint, vector checks, length buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import NORM_TOLERANCE, all_finite, as_doubles, norm
from lodestone.operators.ranking import global_position

FINGERPRINT_WORDS = 8


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Rows, documents and characters; needs ``display_path, embedding_text``."""
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.countDistinct("display_path").alias("documents"),
        F.sum(F.length("embedding_text")).alias("characters"),
    )


def corpus_fingerprint(chunks: DataFrame) -> DataFrame:
    """SHA-256 over what the lines of a corpus add up to.

    A line names a chunk's place, id and content hash, so the set of lines fixes
    their order. The 32-bit words of the lines' hashes are summed, each modulo
    2^32: one definition for every size, and sums that tasks share.
    """
    key = ["display_path", "ordinal", "chunk_id", "content_hash"]
    line = F.sha2(F.concat_ws(":", *[F.col(name).cast("string") for name in key]), 256)
    words = [
        F.conv(F.substring(line, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(FINGERPRINT_WORDS)
    ]
    folded = [F.sum(w.cast("decimal(28,0)")) % (1 << 32) for w in words]
    summed = chunks.agg(
        F.count("*").alias("chunks"),
        *[F.coalesce(w, F.lit(0)).cast("bigint").alias(f"w{i}") for i, w in enumerate(folded)],
    )
    total = F.col("chunks").cast("string")
    header = F.concat(F.lit("total:"), total, F.lit("\nselected:"), total, F.lit("\n"))
    sums = F.concat_ws(",", *[F.col(f"w{i}").cast("string") for i in range(FINGERPRINT_WORDS)])
    return summed.select(F.sha2(F.concat(header, sums), 256).alias("fingerprint"), "chunks")


def vector_problems(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Every vector with the first rule it breaks, or ``ok``."""
    value = as_doubles(F.col(column))
    length = norm(value)
    problem = (
        F.when(F.col(column).isNull() | (F.size(column) == 0), "empty")
        .when(F.size(column) != dimension, "dimension")
        .when(~all_finite(value), "not-finite")
        .when(F.abs(length - 1) > NORM_TOLERANCE, "not-normalized")
        .otherwise("ok")
    )
    return vectors.withColumn("norm", length).withColumn("problem", problem)


def length_buckets(texts: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Batch number of every text when ordered by length, then by ``key``."""
    measured = texts.select(key, F.length(text).alias("length"))
    placed = global_position(measured, ["length", key], "position", "lengths")
    return placed.withColumn("batch", F.expr(f"position div {int(size)}"))


def located(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add ``chunk_id`` to results by path and line range; a miss is an error."""
    place = ["display_path", "start_line", "end_line"]
    known = chunks.select(*place, F.col("chunk_id").alias("_id"))
    missing = F.concat(
        F.lit("Result is absent from the corpus: "),
        F.concat_ws(":", *[F.col(name).cast("string") for name in place]),
    )
    found = F.coalesce("_id", F.raise_error(missing).cast("bigint"))
    return results.join(known, place, "left").withColumn("chunk_id", found).drop("_id")
