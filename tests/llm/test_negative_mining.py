import random

import duckdb
import numpy as np
import pytest

from lodestone.llm import negative_mining as nm
from lodestone.llm.registry import CHECKS, QUERIES
from lodestone.session import materialize

FOLDER = "/root/testdata/sf0.001"


def _brute(rows, each, n=5):
    """``rows`` are distinct ``(id, label, ints)``."""
    out = []
    for a, label, x in rows:
        if a % each:
            continue
        scored = [(-int(np.dot(x, y)), i, other) for i, other, y in rows if i != a and len(x) == len(y)]
        for minus, positive, _ in sorted(s for s in scored if s[2] == label)[:n]:
            inside = sorted(s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus)
            out += [(a, positive, r, i, -minus, -m) for r, (m, i, _) in enumerate(inside[:n], 1)]
    return sorted(out)


def _run(spark, rows, each, n=5):
    frame = spark.createDataFrame(
        [(i, label, [v / 256 for v in x]) for i, label, x in rows], "vec_id long, label int, embedding array<double>"
    )
    stored = materialize(nm.summarised(frame), "test-summaries")
    found = nm.mine(stored, stored.where(f"vec_id % {each} = 0"), n, n)
    return sorted(tuple(r) for r in found.collect())


def _clouds(seed, count, width, spread=9):
    rng = random.Random(seed)
    centres = [[rng.randint(-60, 60) for _ in range(width)] for _ in range(4)]
    return [
        (i, rng.randrange(3), [c + rng.randint(-spread, spread) for c in centres[i % 4]]) for i in range(count)
    ]


@pytest.mark.parametrize("width", [1, 3, 17, 64])
def test_equals_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(nm, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(nm, "CELLS", 300)
    rows = _clouds(width, 150, width)
    assert _run(spark, rows, 6) == _brute(rows, 6)


def test_ties_and_many_copies_of_one_vector(spark):
    rows = [(i, i % 2, [5, 5, 5, 5]) for i in range(60)] + [(i, i % 3, [5, 5, 5, 4]) for i in range(60, 90)]
    assert _run(spark, rows, 10) == _brute(rows, 10)


def test_lengths_meet_only_their_own(spark):
    rows = _clouds(1, 40, 3) + [(100 + i, label, x) for i, label, x in _clouds(2, 40, 5)]
    assert _run(spark, rows, 4) == _brute(rows, 4)


def test_few_rows_zero_and_negative_scores(spark):
    rows = [(0, 1, [1, 0]), (1, 1, [0, 3]), (2, 2, [0, -4]), (3, 1, [-2, 0]), (4, 2, [0, 1])]
    assert _run(spark, rows, 5) == _brute(rows, 5)
    assert _run(spark, rows[:1], 5) == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, i % 2, [2**29 + i, -(2**27) - 3 * i, 1]) for i in range(20)]
    assert _run(spark, rows, 4) == _brute(rows, 4)


def test_bounds_hold_and_leave_most_pairs_out():
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(size=(20, 16)) * 40, 4, axis=1)  # of little deviation in a segment
    vectors = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 64)) * 4).round().astype(np.int64)
    means, deviations = nm.summaries(vectors)
    exact = vectors[:50] @ vectors.T
    tighter = []
    for level in nm.levels(means, deviations, 64):
        middle = level.means[:50] @ level.means.T
        spread = level.deviations[:50] @ level.deviations.T + 1e-6
        assert (middle - spread <= exact).all() and (exact <= middle + spread).all()
        tighter.append(spread.mean())
    assert tighter == sorted(tighter, reverse=True)

    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    block = nm.Block(np.arange(3000), np.zeros(3000, np.int64), vectors, norms, nm.levels(means, deviations, 64))
    some = nm.Block(np.arange(50), block.labels[:50], vectors[:50], norms[:50], nm.levels(means[:50], deviations[:50], 64))
    kept = nm.Kept(50, 5)
    everything = nm.Windows(np.full((50, 1), nm.LEAST), np.full((50, 1), nm.MOST))
    tally = nm.refine(some, everything, kept, block, same=True)
    assert tally.pairs == 50 * 2999
    assert tally.exact < tally.pairs / 20


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [0.5, -0.001]), (1, 1, None), (2, 1, []), (3, 1, [1.0, None]), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]),
        (None, 1, [1.0, 1.0]), (6, None, [1.0, 1.0]), (7, 2, [0.5, 0.5]), (7, 2, [0.5, 0.5]), (7, 1, [0.75, 0.5]),
    ]
    frame = spark.createDataFrame(
        [(*r, "x", 3) for r in rows], "vec_id long, label int, embedding array<float>, ints string, means int"
    )
    got = sorted((r["vec_id"], r["label"], r["ints"]) for r in nm.summarised(frame).collect())
    assert got == [(0, 1, [128, -1]), (7, 1, [192, 128])]
    none = materialize(nm.summarised(frame.limit(0)), "test-none")
    assert nm.mine(none, none).count() == 0


def test_query_equals_its_check(spark):
    got = QUERIES["op12_hard_negatives"](spark, FOLDER).collect()
    tables = duckdb.connect()
    tables.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    expected = tables.execute(CHECKS["op12_hard_negatives"]).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(expected)
