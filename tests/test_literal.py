"""Substring search over the stored index of runs, against plain Python."""

import random

import pytest

from lodestone.operators import literal
from lodestone.operators.literal import containing, index_runs, scanned


def _frames(spark, texts, patterns):
    left = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    right = spark.createDataFrame(list(enumerate(patterns)), "pattern_id bigint, pattern string")
    return left, right


def _brute(texts, patterns):
    return {
        (p, t) for p, pattern in enumerate(patterns) if pattern for t, text in enumerate(texts) if text and pattern in text
    }


TEXTS = [
    "abcabc", "", None, "a", "ab", "Straße 1\nzwei", "ΟΔΟΣ και ΟΔΟΣΑ", "İstanbul", "x😀y😀z", "AbC", "tail ab", "  spaced  ",
    ".*+?[](){}^$|\\", "abcabc",
]
PATTERNS = [
    "abc", "a", "ab", "", None, "bca", "ße 1\nz", "ΟΔΟΣ", "ΔΟΣ", "Σ", "İs", "😀y😀", "😀", "C", "nowhere", "zzz", "  ",
    ".*+", "[](", "\\", "tail ab", "tail abc",
]


@pytest.mark.parametrize("size", [2, 1024])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(literal, "BLOCK_IDS", size)
    left, right = _frames(spark, TEXTS, PATTERNS)
    index = index_runs(left)
    assert {tuple(r) for r in containing(index, right).collect()} == _brute(TEXTS, PATTERNS)
    lower = [t and t.lower() for t in TEXTS], [p and p.lower() for p in PATTERNS]
    assert {tuple(r) for r in containing(index, right, any_case=True).collect()} == _brute(*lower)


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abAB ", k=rng.randint(0, 40))) for _ in range(200)]
    patterns = ["".join(rng.choices("abAB ", k=rng.randint(1, 7))) for _ in range(60)]
    left, right = _frames(spark, texts, patterns)
    rows = containing(index_runs(left), right).collect()
    assert {tuple(r) for r in rows} == _brute(texts, patterns) and len(rows) == len(set(rows))


def test_a_search_cuts_no_text_and_opens_asked_buckets(spark):
    left, right = _frames(spark, ["one text", "another text"], ["her"])
    plan = containing(index_runs(left), right)._jdf.queryExecution().toString()
    assert "split(" not in plan and "regexp_extract_all" not in plan.split("== Physical Plan ==")[1]


def test_a_run_of_every_text_is_cut_in_blocks(spark):
    left, right = _frames(spark, ["same text"] * 3000, ["same"])
    index = index_runs(left)
    sizes = index.blocks.where("run = 'sam'").selectExpr("size(at) as n").collect()
    assert sum(r.n for r in sizes) == 3000 and max(r.n for r in sizes) <= literal.BLOCK_IDS
    assert containing(index, right).count() == 3000


def test_without_texts_or_patterns(spark):
    left, right = _frames(spark, ["abc"], ["abc"])
    assert containing(index_runs(left.limit(0)), right).count() == 0
    assert containing(index_runs(left), right.limit(0)).count() == 0


@pytest.mark.parametrize("most", [3, 4096])
def test_scan_without_an_index_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(literal, "SCANNED", most)
    left, right = _frames(spark, TEXTS, PATTERNS)
    right = right.unionByName(right)  # rows that come twice
    rows = [tuple(r) for r in scanned(left, right).collect()]
    assert set(rows) == _brute(TEXTS, PATTERNS) and len(rows) == len(set(rows))
    lower = [t and t.lower() for t in TEXTS], [p and p.lower() for p in PATTERNS]
    assert {tuple(r) for r in scanned(left, right, any_case=True).collect()} == _brute(*lower)
    assert scanned(left, right.limit(0)).count() == 0


def test_a_few_patterns_need_no_index(spark, monkeypatch):
    monkeypatch.setattr(literal, "index_runs", lambda texts: pytest.fail("an index of all texts was made"))
    left, right = _frames(spark, TEXTS, PATTERNS)
    assert {tuple(r) for r in scanned(left, right).collect()} == _brute(TEXTS, PATTERNS)
