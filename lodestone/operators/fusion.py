"""Joining the two routes, scoring what they found, and the final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import SearchConfig
from lodestone.functions import scoring

CANDIDATE_CAP = 500


def candidate_limit(top: Column, pool: int) -> Column:
    wanted = F.greatest(F.lit(pool), F.coalesce(top, F.lit(0)) * 10)
    return F.least(F.lit(CANDIDATE_CAP), wanted)


def location_score(distance: Column, rank: Column) -> Column:
    """Score of a single route's result: similarity, or its reciprocal rank."""
    return F.coalesce(1 - distance, 1 / rank)


def fuse_routes(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """One row per query and passage found by either route."""
    left = vector.select("qid", "chunk_id", "distance", "vector_rank")
    right = keyword.select("qid", "chunk_id", "keyword_rank")
    return left.join(right, ["qid", "chunk_id"], "full_outer")


def recognised_parts(part_terms: Column, indexed_terms: Column) -> Column:
    """Bit mask of the query parts with a term among ``indexed_terms``.

    Only queries of at most five parts are ever relaxed, so a mask is enough.
    """
    return F.aggregate(
        F.transform(part_terms, lambda terms, i: F.struct(terms.alias("terms"), i.alias("i"))),
        F.lit(0),
        lambda acc, part: acc
        + F.when(
            F.arrays_overlap(part["terms"], indexed_terms), F.pow(F.lit(2), part["i"]).cast("int")
        ).otherwise(0),
    )


def with_text_evidence(found: DataFrame, pool: int) -> DataFrame:
    """Reduce the term lists of a candidate to its lexical strength and to the
    mask of recognised parts, before anything is shuffled by query."""
    lexical = scoring.lexical_strength(
        F.col("terms"), F.col("terms_weight"), F.col("indexed_terms")
    )
    counted = (F.col("mode") == "terms") & (F.col("keyword_rank") <= pool)
    mask = F.when(counted, recognised_parts(F.col("part_terms"), F.col("indexed_terms")))
    return (
        found.withColumn("lexical", lexical)
        .withColumn("mask", mask)
        .withColumn("parts", F.size("part_terms"))
        .drop("indexed_terms", "terms", "terms_weight", "part_terms")
    )


def with_relaxation(found: DataFrame) -> DataFrame:
    """Whether a terms query has enough of its parts in the found vocabulary."""
    seen = F.bit_count(F.bit_or("mask").over(Window.partitionBy("qid")))
    enough = (F.col("parts") > 0) & (seen >= F.least(F.lit(2), F.col("parts")))
    relaxed = (F.col("mode") == "terms") & F.coalesce(enough, F.lit(False))
    return found.withColumn("relaxed", relaxed).drop("mask", "parts")


def score_candidates(candidates: DataFrame, config: SearchConfig) -> DataFrame:
    """Add strengths, confidence, trust and score to fused candidates.

    Needs ``lexical, relaxed, distance, vector_rank, keyword_rank``.
    """
    relaxed = F.col("relaxed")
    lexical, semantic = F.col("lexical"), F.col("semantic")
    signals = (
        candidates.withColumn(
            "semantic", scoring.semantic_strength(config, F.col("distance"), relaxed)
        )
        .withColumn(
            "fusion",
            scoring.reciprocal_rank_fusion(config, F.col("vector_rank"), F.col("keyword_rank")),
        )
        .withColumn("confidence", F.greatest(lexical, semantic))
    )
    reason = scoring.confidence_reason(
        config,
        relaxed,
        F.col("confidence"),
        lexical,
        F.col("distance"),
        F.col("vector_rank"),
        F.col("keyword_rank"),
    )
    return signals.withColumn("reason", reason).withColumn(
        "score", scoring.blended_score(F.col("fusion"), lexical, semantic)
    )


def final_order() -> list[Column]:
    return [
        F.desc("score"),
        F.desc("confidence"),
        F.asc_nulls_last("vector_rank"),
        F.asc_nulls_last("keyword_rank"),
        F.collate("display_path", "UNICODE").asc(),
        F.asc("start_line"),
        # A last key, so that equal places cannot swap between runs.
        F.asc("chunk_id"),
    ]


def rank_results(scored: DataFrame) -> DataFrame:
    """Trusted candidates in final order, cut to each query's own ``top``."""
    trusted = scored.filter(F.col("reason") != "rejected")
    by_query = Window.partitionBy("qid").orderBy(*final_order())
    ranked = trusted.withColumn("rank", F.row_number().over(by_query))
    return ranked.filter(F.col("top").isNull() | (F.col("rank") <= F.col("top")))
