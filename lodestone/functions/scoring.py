"""Evidence and score expressions of the fused ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import SearchConfig
from lodestone.functions.text import HAN

# Fixed values of the ranking formula.
RANK_OFFSET = 8
FUSION_SHARE, LEXICAL_SHARE, SEMANTIC_SHARE = 0.6, 0.2, 0.2
DUAL_RANK, DUAL_FACTOR = 5, 0.7
TERM_RANK, TERM_FACTOR = 3, 0.5


def unit(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def term_weight(term: Column) -> Column:
    size = F.char_length(term)
    return (
        F.when(~term.rlike(f"^{HAN}+$"), 4).when(size >= 4, 3).when(size == 3, 2).otherwise(1)
    )


def total_weight(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0), lambda acc, term: acc + term_weight(term))


def lexical_strength(query_terms: Column, total: Column, indexed_terms: Column) -> Column:
    """Weighted share of the query found, damped while little was found.

    ``total`` is the weight of all query terms, computed once per query.
    """
    found = total_weight(F.array_intersect(query_terms, indexed_terms))
    strength = F.sqrt(found / total * (1 - F.exp(-found / 3)))
    return F.when(found > 0, strength).otherwise(F.lit(0.0))


def weak_distance(config: SearchConfig, relaxed: Column) -> Column:
    best, weak = config.semantic_best_distance, config.semantic_weak_distance
    return F.when(relaxed, F.lit(weak + (weak - best))).otherwise(F.lit(weak))


def semantic_strength(config: SearchConfig, distance: Column, relaxed: Column) -> Column:
    weak = weak_distance(config, relaxed)
    strength = unit((weak - distance) / (weak - config.semantic_best_distance))
    return F.when(distance.isNull(), F.lit(0.0)).otherwise(strength)


def reciprocal_rank_fusion(
    config: SearchConfig, vector_rank: Column, keyword_rank: Column
) -> Column:
    """Weighted reciprocal ranks, scaled so that two first places give 1."""

    def share(weight: float, rank: Column) -> Column:
        return F.coalesce(F.lit(weight) / (RANK_OFFSET + rank), F.lit(0.0))

    best = (config.vector_weight + config.keyword_weight) / (RANK_OFFSET + 1)
    both = share(config.vector_weight, vector_rank) + share(config.keyword_weight, keyword_rank)
    return unit(both / best)


def confidence_reason(
    config: SearchConfig,
    relaxed: Column,
    confidence: Column,
    lexical: Column,
    distance: Column,
    vector_rank: Column,
    keyword_rank: Column,
) -> Column:
    """Which rule trusts a candidate, or ``rejected``."""
    floor = config.minimum_confidence
    dual = (vector_rank <= DUAL_RANK) & (keyword_rank <= DUAL_RANK)
    near = (vector_rank <= TERM_RANK) & (distance <= weak_distance(config, relaxed))
    named = (keyword_rank <= TERM_RANK) & (lexical >= floor * TERM_FACTOR)
    return (
        F.when(confidence >= floor, "signal")
        .when(dual & (confidence >= floor * DUAL_FACTOR), "dual-route")
        .when(relaxed & near, "term-vector")
        .when(relaxed & named, "term-keyword")
        .otherwise("rejected")
    )


def blended_score(fusion: Column, lexical: Column, semantic: Column) -> Column:
    return unit(fusion * FUSION_SHARE + lexical * LEXICAL_SHARE + semantic * SEMANTIC_SHARE)
