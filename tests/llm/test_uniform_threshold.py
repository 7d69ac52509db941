import random

import duckdb

from lodestone.llm import uniform_threshold as ut
from lodestone.llm.registry import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


def _brute(rows, k, each):
    rows = sorted(set((i, tuple(v)) for i, v in rows))
    out = []
    for q, x in rows:
        if q % each == 0:
            scored = [
                (-sum(a * b for a, b in zip(x, y, strict=True)), c)
                for c, y in rows
                if c != q and len(x) == len(y)
            ]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def _run(spark, rows, k=3, each=4):
    frame = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, ints array<long>")
    found = ut.top_k(frame.where(f"vec_id % {each} = 0").distinct(), frame.distinct(), k)
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


def test_equals_brute_force_over_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ut, "SHARD_ROWS", 7)
    monkeypatch.setattr(ut, "QUERY_ROWS", 3)
    random.seed(5)
    rows = [(i, [random.randint(-9, 9) for _ in range(5)]) for i in range(40)]
    rows += [(i, [3, 3, 3, 3, 3]) for i in range(40, 70)]  # ties
    rows += [rows[0], rows[41]]  # repeated rows
    assert _run(spark, rows) == _brute(rows, 3, 4)


def test_few_rows_and_negative_scores(spark):
    rows = [(0, [1, 2]), (1, [-5, -5]), (2, [-1, 0])]
    assert _run(spark, rows, k=5) == _brute(rows, 5, 4)
    assert _run(spark, rows[:1], k=5) == []
    assert _run(spark, rows[1:2], k=5) == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2**30 + i, -(2**29) - i, 1]) for i in range(6)]
    assert _run(spark, rows, k=2, each=1) == _brute(rows, 2, 1)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.001]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]),
        (None, [1.0, 1.0]), (6, [0.5, -0.001]), (6, [0.5, -0.001]), (7, [-inf, 0.0]),
    ]
    frame = spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, ints int, shard string"
    )
    got = sorted((r["vec_id"], r["ints"]) for r in ut.scaled_vectors(frame).collect())
    assert got == [(0, [128, -1]), (6, [128, -1])]
    assert ut.top_k(ut.scaled_vectors(frame.limit(0)), ut.scaled_vectors(frame.limit(0))).count() == 0


def test_stores_nothing_but_results(spark, monkeypatch):
    """Pairs of query blocks and shards would grow with the square of the table."""
    monkeypatch.setattr(ut, "SHARD_ROWS", 5)
    monkeypatch.setattr(ut, "QUERY_ROWS", 4)
    stored, write = [], ut.materialize

    def recorded(frame, label):
        written = write(frame, label)
        stored.append((written.columns, written.count()))
        return written

    monkeypatch.setattr(ut, "materialize", recorded)
    random.seed(6)
    rows = [(i, [random.randint(-9, 9) for _ in range(4 + i % 2)]) for i in range(48)]
    # Two rows of one id: their entries are ranked together, also from two blocks.
    rows += [(i, [random.randint(-9, 9) for _ in range(4)]) for i in range(0, 48, 8)]
    got = _run(spark, rows, k=2, each=4)
    rows = sorted(set((i, tuple(v)) for i, v in rows))
    scored = {}
    for q, x in rows:
        if q % 4 == 0:
            found = [(-sum(map(int.__mul__, x, y)), c) for c, y in rows if c != q and len(x) == len(y)]
            scored.setdefault(q, []).extend(found)
    assert got == sorted((q, n, c, -s) for q, found in scored.items() for n, (s, c) in enumerate(sorted(found)[:2], 1))
    assert all(columns == ["query_id", "rank", "vec_id", "score"] for columns, _ in stored)
    assert sum(n for _, n in stored) <= 2 * sum(q % 4 == 0 for q, _ in rows)


def test_query_equals_its_check(spark):
    got = QUERIES["op8_exact_top_k"](spark, FOLDER).collect()
    tables = duckdb.connect()
    tables.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    expected = tables.execute(CHECKS["op8_exact_top_k"]).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(expected)
