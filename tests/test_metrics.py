import pytest

from lodestone.errors import NavigationError
from lodestone.operators import metrics
from lodestone.operators.suites import SUITE, checked_cases, flat_cases

OBSERVED = (
    "case_id string, category string, expected_rank int, results bigint, deterministic boolean, "
    "first string"
)


def test_product_metrics_and_failures(spark):
    rows = [
        ("a", "semantic", 2, 2, True, "x.md:1"),
        ("b", "filter", 1, 1, True, "y.md:1"),
        ("c", "negative", None, 0, True, None),
        ("d", "exact", None, 1, True, "z.md:9"),
        ("e", "negative", None, 1, False, "q.md:4"),
    ]
    frame = spark.createDataFrame(rows[:3], OBSERVED)
    found = metrics.product_metrics(frame).first().asDict()
    assert found == {
        "positive_recall_at_5": 1.0,
        "positive_top_1": 0.5,
        "mrr": 0.75,
        "exact_top_1": 0.0,
        "negative_rejection": 1.0,
        "determinism": 1.0,
    }
    failures = metrics.failure_messages(spark.createDataFrame(rows, OBSERVED)).collect()
    assert sorted(r.message for r in failures) == [
        "d: exact term expected at rank 1, got missing",
        "d: expected location missing; first was z.md:9",
        "e: expected no result, got q.md:4",
        "e: repeated results changed",
    ]


def test_expected_rank_checks_path_and_heading(spark):
    results = spark.createDataFrame(
        [("a", 1, "x.md", ["Intro"]), ("a", 2, "x.md", ["Top", "How to run"]), ("b", 1, "z.md", [])],
        "case_id string, rank int, display_path string, heading array<string>",
    )
    expected = spark.createDataFrame(
        [("a", "x.md", "run"), ("b", "y.md", None), ("b", "z.md", None)],
        "case_id string, display_path string, heading string",
    )
    found = {r.case_id: r.expected_rank for r in metrics.expected_rank(results, expected).collect()}
    assert found == {"a": 2, "b": 1}


def test_route_coverage(spark):
    def route(ranks):
        return spark.createDataFrame(list(zip("ab", ranks)), "case_id string, expected_rank int")

    found = metrics.route_coverage(route([1, None]), route([6, 5]), route([2, 9])).first()
    assert found.asDict() == {
        "vector_recall_at_5": 0.5,
        "keyword_recall_at_5": 0.5,
        "union_recall_at_5": 1.0,
        "hybrid_recall_at_5": 0.5,
        "union_hits": 2,
        "retained_union_hits": 1,
        "union_retention_rate_at_5": 0.5,
    }


def test_sparse_metrics(spark):
    rows = [
        ("i", "single-term", 1, True, True, 9),
        ("i", "term-bundle", None, True, True, 9),
        ("j", "single-term", 3, True, False, 0),
        ("j", "term-bundle", 8, True, False, 0),
        ("k", "legacy", 1, True, True, 1),
    ]
    frame = spark.createDataFrame(
        rows,
        "intent_id string, kind string, expected_rank int, stable boolean, literal_match boolean, "
        "literal_candidates bigint",
    )
    found = metrics.intent_metrics(frame).first()
    assert (found.intents, found.probes) == (2, 4)
    assert (found.macro_recall_at_5, found.any_recall_at_5) == (0.5, 1.0)
    assert (found.rescue_hits_at_5, found.rescue_eligible, found.rescue_rate_at_5) == (1, 2, 0.5)
    assert (found.compression_hits_at_5, found.compression_eligible) == (1, 2)
    kinds = {r.kind: r for r in metrics.kind_metrics(frame).collect()}
    assert set(kinds) == {"single-term", "term-bundle"}
    assert kinds["single-term"].recall_at_5 == 1.0 and kinds["term-bundle"].mrr == 1 / 16


def test_stable_cases(spark):
    shape = "case_id string, rank int, chunk_id int"
    one = spark.createDataFrame([("a", 1, 5), ("a", 6, 7), ("b", 1, 5)], shape)
    two = spark.createDataFrame([("a", 1, 5), ("a", 6, 8), ("b", 1, 6)], shape)
    found = metrics.stable_cases(one, two, ["chunk_id"], depth=5).collect()
    assert {r.case_id: r.stable for r in found} == {"a": True, "b": False}


def suite(spark, probes):
    place = [("a.md", "H")]
    return spark.createDataFrame([(2, None, [("i", place, probes)])], SUITE)


def test_suites(spark):
    good = [
        ("s", "single-term", ["one"]),
        ("b", "term-bundle", ["one", " two "]),
        ("v", "alternate-vocabulary", ["three"]),
    ]
    cases = {r.case_id: r for r in checked_cases(suite(spark, good)).collect()}
    assert set(cases) == {"i/s", "i/b", "i/v"} and cases["i/b"].query == "one two"
    legacy = spark.createDataFrame([(1, [("c", "q w", [("a.md", None)])], None)], SUITE)
    (row,) = flat_cases(legacy).collect()
    assert (row.kind, list(row.terms), row.intent_id) == ("legacy", ["q w"], "c")
    for bad in (good[:2], good[:2] + [("b", "alternate-vocabulary", ["x"])],
                [("s", "single-term", ["a", "b"])] + good[1:]):
        with pytest.raises(NavigationError):
            checked_cases(suite(spark, bad))
