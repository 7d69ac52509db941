"""The cell index against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import cells
from lodestone.operators.cells import index_cells, nearest_in_cells
from lodestone.operators.nearest import nearest

SHAPE = "chunk_id bigint, display_path string, start_line int, embedding array<float>"


def _frame(spark, rows):
    listed = [
        (i, f"d{(i * 7) % 50:02d}.md", i % 5, None if row is None else [float(x) for x in row])
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(listed, SHAPE)


def _clouds(rng, count, width=16, clouds=12, spread=0.02):
    centres = rng.normal(size=(clouds, width))
    return (centres[rng.integers(0, clouds, count)] + rng.normal(size=(count, width)) * spread).astype(np.float32)


def _ask(spark, rows):
    return spark.createDataFrame(
        [(i, None if row is None else [float(x) for x in row]) for i, row in enumerate(rows)], "qid bigint, vector array<float>"
    )


def _rows(found):
    return sorted(tuple(r) for r in found.select("qid", "vector_rank", "chunk_id", "distance").collect())


@pytest.mark.parametrize("spread,block", [(0.02, 4096), (1.0, 3)])
def test_equals_a_full_scan(spark, monkeypatch, spread, block):
    monkeypatch.setattr(cells, "QUERY_BLOCK", block)
    rng = np.random.default_rng(5)
    rows = _clouds(rng, 700, spread=spread)
    rows[::3] = rows[0]  # a third are copies of one vector
    frame = _frame(spark, [*rows, None, np.zeros(16)])
    asked = _ask(spark, [rows[0], rows[1], rows[4], -rows[2], rng.normal(size=16), None, rows[7]])
    index = index_cells(frame)
    assert index.size.sum() == 700
    for k in (1, 9, 300):
        found = nearest_in_cells(index, asked, k)
        assert _rows(found.rows) == _rows(nearest(frame.limit(700), asked, k))
        assert 0 < found.read <= found.pairs


def test_far_cells_are_not_read(spark):
    rng = np.random.default_rng(6)
    rows = _clouds(rng, 2000, clouds=40, spread=0.01)
    found = nearest_in_cells(index_cells(_frame(spark, rows), cells=200), _ask(spark, rows[:20]), 5)
    assert _rows(found.rows) == _rows(nearest(_frame(spark, rows), _ask(spark, rows[:20]), 5))
    assert found.read < found.pairs / 4


def test_filters_apply_before_ranking(spark):
    rng = np.random.default_rng(7)
    rows = _clouds(rng, 400)
    frame = _frame(spark, rows)
    odd = F.when(F.col("chunk_id") % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    none = F.when(F.col("chunk_id") < 3, F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    scoped = frame.withColumn("scopes", F.array_union(odd, none))
    asked = _ask(spark, rows[:6]).withColumn("scope", (F.col("qid") % 3).cast("int"))
    found = nearest_in_cells(index_cells(frame), asked, 7, scoped.select("chunk_id", "scopes"))
    assert _rows(found.rows) == _rows(nearest(scoped, asked, 7))


def test_without_vectors_or_queries(spark):
    frame = _frame(spark, [None, np.zeros(4), np.ones(4)])
    asked = _ask(spark, [np.ones(4)])
    assert nearest_in_cells(index_cells(frame.limit(0)), asked, 3).rows.count() == 0
    assert nearest_in_cells(index_cells(frame), asked.limit(0), 3).rows.count() == 0
    assert [r.chunk_id for r in nearest_in_cells(index_cells(frame), asked, 3).rows.collect()] == [2]


def test_mixed_dimensions_are_refused(spark):
    index = index_cells(_frame(spark, [np.ones(4)] * 3))
    with pytest.raises(Exception, match="differ in dimension"):
        nearest_in_cells(index, _ask(spark, [np.ones(5)]), 3)
