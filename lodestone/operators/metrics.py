"""Retrieval quality as aggregations over observation frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 5
KINDS = ("single-term", "term-bundle", "alternate-vocabulary")


def _mean(hit: Column, among: Column | None = None) -> Column:
    """Mean of a 0/1 or fractional column, 0 when nothing qualifies."""
    counted = F.when(among, hit) if among is not None else hit
    return F.coalesce(F.avg(counted), F.lit(0.0))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def expected_rank(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Best rank per case at which an expected location was returned.

    ``expected`` holds ``case_id, display_path`` and an optional ``heading``
    that some part of the result's heading path has to contain.
    """
    wanted = expected.select(
        "case_id", "display_path", *(["heading"] if "heading" in expected.columns else [])
    )
    if "heading" in wanted.columns:
        wanted = wanted.withColumnRenamed("heading", "_heading")
    joined = results.join(wanted, ["case_id", "display_path"])
    if "_heading" in wanted.columns:
        named = F.exists("heading", lambda part: F.contains(part, F.col("_heading")))
        joined = joined.filter(F.col("_heading").isNull() | named)
    return joined.groupBy("case_id").agg(F.min("rank").alias("expected_rank"))


def stable_cases(
    first: DataFrame, second: DataFrame, columns: list[str], depth: int | None = None
) -> DataFrame:
    """Whether two runs returned the same rows at the same ranks, per case."""
    keep = F.lit(True) if depth is None else F.col("rank") <= depth
    left = first.filter(keep).select("case_id", "rank", F.struct(*columns).alias("_a"))
    right = second.filter(keep).select("case_id", "rank", F.struct(*columns).alias("_b"))
    both = left.join(right, ["case_id", "rank"], "full_outer")
    return both.groupBy("case_id").agg(F.every(F.col("_a").eqNullSafe(F.col("_b"))).alias("stable"))


def product_metrics(observations: DataFrame) -> DataFrame:
    """One row from ``category, expected_rank, results, deterministic``."""
    rank = F.col("expected_rank")
    positive = F.col("category") != "negative"
    found = _flag(rank <= DEPTH)
    return observations.agg(
        _mean(found, positive).alias("positive_recall_at_5"),
        _mean(_flag(rank == 1), positive).alias("positive_top_1"),
        _mean(F.when(rank <= DEPTH, 1 / rank).otherwise(0.0), positive).alias("mrr"),
        _mean(_flag(rank == 1), F.col("category") == "exact").alias("exact_top_1"),
        _mean(_flag(F.col("results") == 0), ~positive).alias("negative_rejection"),
        _mean(_flag(F.col("deterministic"))).alias("determinism"),
    )


def failure_messages(observations: DataFrame) -> DataFrame:
    """One row per broken expectation, as text; needs ``case_id`` and ``first``."""
    rank = F.col("expected_rank")
    negative = F.col("category") == "negative"
    where = F.coalesce(F.col("first"), F.lit("empty"))
    missed = ~negative & ~F.coalesce(rank <= DEPTH, F.lit(False))
    messages = F.array_compact(
        F.array(
            F.when(~F.col("deterministic"), F.lit("repeated results changed")),
            F.when(
                negative & (F.col("results") > 0),
                F.concat(F.lit("expected no result, got "), where),
            ),
            F.when(missed, F.concat(F.lit("expected location missing; first was "), where)),
            F.when(
                (F.col("category") == "exact") & ~F.coalesce(rank == 1, F.lit(False)),
                F.concat(
                    F.lit("exact term expected at rank 1, got "),
                    F.coalesce(rank.cast("string"), F.lit("missing")),
                ),
            ),
        )
    )
    rows = observations.select("case_id", F.explode(messages).alias("_message"))
    return rows.select("case_id", F.concat_ws(": ", "case_id", "_message").alias("message"))


def threshold_checks(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``name, value, threshold, passed`` for every gated metric."""
    checks = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.col(name).alias("value"),
                F.lit(float(least)).alias("threshold"),
            )
            for name, least in thresholds.items()
        ]
    )
    rows = metrics.select(F.explode(checks).alias("check")).select("check.*")
    return rows.withColumn("passed", F.col("value") >= F.col("threshold"))


def core_metrics() -> list[Column]:
    """Benchmark means over all observations; reciprocal rank at any depth."""
    rank = F.col("expected_rank")
    return [
        _mean(_flag(rank <= DEPTH)).alias("recall_at_5"),
        _mean(_flag(rank == 1)).alias("top_1"),
        _mean(F.coalesce(1 / rank, F.lit(0.0))).alias("mrr"),
        _mean(_flag(F.col("stable"))).alias("stability"),
    ]


def _rescue() -> list[Column]:
    hit = _flag(F.col("expected_rank") <= DEPTH)
    missed = ~F.col("literal_match")
    return [
        F.count_if(missed).alias("literal_misses"),
        _mean(hit, missed).alias("semantic_rescue_rate_at_5"),
    ]


def kind_metrics(observations: DataFrame) -> DataFrame:
    sparse = observations.filter(F.col("kind").isin(*KINDS))
    return sparse.groupBy("kind").agg(F.count("*").alias("probes"), *core_metrics(), *_rescue())


def intent_metrics(observations: DataFrame) -> DataFrame:
    """Means over intents and conditional rates over probes, in one row."""
    hit = F.coalesce(F.col("expected_rank") <= DEPTH, F.lit(False))
    literal = F.col("literal_match")
    crowded = literal & (F.col("literal_candidates") > DEPTH)
    per_intent = (
        observations.filter(F.col("kind") != "legacy")
        .groupBy("intent_id")
        .agg(
            F.count("*").alias("probes"),
            F.count_if(hit).alias("hits"),
            F.count_if(literal).alias("literal"),
            F.count_if(~literal & hit).alias("rescued"),
            F.count_if(crowded).alias("crowded"),
            F.count_if(crowded & hit).alias("compressed"),
        )
    )

    def rate(hits: Column, eligible: Column) -> Column:
        return F.when(eligible > 0, hits / eligible).otherwise(0.0)

    probes, literal_hits = F.sum("probes"), F.sum("literal")
    missed = probes - literal_hits
    return per_intent.agg(
        F.count("*").alias("intents"),
        probes.alias("probes"),
        F.avg(F.col("hits") / F.col("probes")).alias("macro_recall_at_5"),
        _mean(_flag(F.col("hits") > 0)).alias("any_recall_at_5"),
        rate(literal_hits, probes).alias("literal_target_rate"),
        missed.alias("rescue_eligible"),
        F.sum("rescued").alias("rescue_hits_at_5"),
        rate(F.sum("rescued"), missed).alias("rescue_rate_at_5"),
        F.sum("crowded").alias("compression_eligible"),
        F.sum("compressed").alias("compression_hits_at_5"),
        rate(F.sum("compressed"), F.sum("crowded")).alias("compression_rate_at_5"),
    )


def route_coverage(vector: DataFrame, keyword: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Recall of each route and how much of their union the fusion retained."""

    def hits(observed: DataFrame, name: str) -> DataFrame:
        hit = F.coalesce(F.col("expected_rank") <= DEPTH, F.lit(False))
        return observed.select("case_id", hit.alias(name))

    # Every route must have observed the same cases.
    joined = (
        hits(vector, "v")
        .join(hits(keyword, "k"), "case_id", "full_outer")
        .join(hits(hybrid, "h"), "case_id", "full_outer")
    )
    problem = F.concat(F.lit("Routes are not aligned at case "), F.col("case_id").cast("string"))
    aligned = F.col("v").isNotNull() & F.col("k").isNotNull() & F.col("h").isNotNull()
    joined = joined.withColumn(
        "v", F.when(aligned, F.col("v")).otherwise(F.raise_error(problem).cast("boolean"))
    )
    union = F.col("v") | F.col("k")
    retained = F.count_if(union & F.col("h"))
    return joined.agg(
        _mean(_flag(F.col("v"))).alias("vector_recall_at_5"),
        _mean(_flag(F.col("k"))).alias("keyword_recall_at_5"),
        _mean(_flag(union)).alias("union_recall_at_5"),
        _mean(_flag(F.col("h"))).alias("hybrid_recall_at_5"),
        F.count_if(union).alias("union_hits"),
        retained.alias("retained_union_hits"),
        F.when(F.count_if(union) > 0, retained / F.count_if(union))
        .otherwise(0.0)
        .alias("union_retention_rate_at_5"),
    )


def first_results(results: DataFrame) -> DataFrame:
    """Result count per case and where its first result points."""
    by_case = Window.partitionBy("case_id").orderBy("rank")
    first = results.withColumn("_n", F.row_number().over(by_case))
    place = F.concat_ws(":", "display_path", F.col("start_line").cast("string"))
    return first.groupBy("case_id").agg(
        F.count("*").alias("results"), F.min(F.when(F.col("_n") == 1, place)).alias("first")
    )
