"""Running a quality suite against a project and gating on its metrics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import NavigationError
from lodestone.operators import metrics
from lodestone.operators.fusion import rank_results
from lodestone.operators.suites import read_product_suite
from lodestone.plans.indexing import search_project
from lodestone.session import materialize
from lodestone.sources.providers import HashingProvider, ProviderFactory

_STABLE = ["display_path", "start_line", "end_line", "heading", "score"]


class Report(NamedTuple):
    metrics: DataFrame
    failures: DataFrame
    checks: DataFrame
    passed: bool


def observe(cases: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """One observation per case from two runs of the same searches."""
    expected = cases.select("case_id", F.explode_outer("expected").alias("e")).select(
        "case_id", F.col("e.path").alias("display_path"), F.col("e.heading").alias("heading")
    )
    ranks = metrics.expected_rank(first, expected.filter(F.col("display_path").isNotNull()))
    stable = metrics.stable_cases(first, second, _STABLE).withColumnRenamed(
        "stable", "deterministic"
    )
    return (
        cases.select("case_id", "category")
        .join(ranks, "case_id", "left")
        .join(metrics.first_results(first), "case_id", "left")
        .join(stable, "case_id", "left")
        .fillna({"results": 0, "deterministic": True})
    )


def run_quality(
    spark: SparkSession, root: str, suite: str, factory: ProviderFactory = HashingProvider
) -> Report:
    """Search every case twice, top 5, and judge the results."""
    cases = read_product_suite(spark, suite)
    # A suite is a hand-written file; its cases become one request batch.
    listed = cases.orderBy("case_id").collect()
    if not listed:
        raise NavigationError("INVALID_CONFIG", "The suite has no cases.")
    requests = [
        {
            "query": case.query,
            "query_parts": case.query_parts,
            "path": case.path,
            "top": metrics.DEPTH,
        }
        for case in listed
    ]
    names = spark.createDataFrame(
        [(number, case.case_id) for number, case in enumerate(listed)],
        "qid bigint, case_id string",
    )

    def once() -> DataFrame:
        routes = search_project(spark, root, requests, factory)
        if routes is None:
            raise NavigationError("PROJECT_NOT_INITIALIZED", "Nothing is indexed, so nothing can be judged.")
        found = rank_results(routes.candidates).withColumn("score", F.round("score", 4))
        return materialize(found.join(names, "qid"), "run")

    observed = materialize(observe(cases, once(), once()), "observed")
    figures = metrics.product_metrics(observed)
    checks = metrics.threshold_checks(figures, listed[0].thresholds)
    passed = checks.filter(~F.col("passed")).isEmpty()
    return Report(figures, metrics.failure_messages(observed), checks, passed)
