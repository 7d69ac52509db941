import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.errors import NavigationError
from lodestone.operators.nearest import nearest

SHAPE = "chunk_id bigint, display_path string, start_line int, embedding array<float>"


@pytest.fixture(scope="module")
def vectors(spark):
    """A third of all rows are copies of one vector."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(900, 8)).astype(np.float32)
    rows[::3] = rows[0]
    listed = [(i, f"d{(i * 7) % 50:02d}.md", i % 5, [float(x) for x in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(listed, SHAPE).repartition(5).cache(), listed


def brute(listed, query, k, keep=lambda row: True):
    wanted = np.array(query)
    found = []
    for row in filter(keep, listed):
        v = np.array(row[3])
        distance = 1 - float((wanted * v).sum() / (np.linalg.norm(wanted) * np.linalg.norm(v)))
        found.append((round(distance, 12), row[1], row[2], row[0]))
    return [row[3] for row in sorted(found)[:k]]


def ask(spark, listed, ids):
    return spark.createDataFrame([(i, listed[i][3]) for i in ids], "qid bigint, vector array<float>")


def ranked(found):
    out = {}
    for row in found.orderBy("qid", "vector_rank").collect():
        out.setdefault(row.qid, []).append(row.chunk_id)
    return out


def test_equals_brute_force_with_hot_copies(spark, vectors):
    frame, listed = vectors
    ids = [0, 1, 5, 12]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    found = ranked(nearest(frame, ask(spark, listed, ids), 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert found == {i: brute(listed, listed[i][3], 20) for i in ids}


def test_large_batches_take_the_blocked_way(spark, vectors):
    frame, listed = vectors
    ids = list(range(7))
    plain = ranked(nearest(frame, ask(spark, listed, ids), 15))
    assert ranked(nearest(frame, ask(spark, listed, ids), 15, query_block=3)) == plain


def test_scopes_apply_before_ranking(spark, vectors):
    frame, listed = vectors
    odd = F.when(F.col("chunk_id") % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    asked = ask(spark, listed, [3, 4]).withColumn("scope", F.when(F.col("qid") == 3, 0).otherwise(1))
    found = ranked(nearest(frame.withColumn("scopes", odd), asked, 10))
    assert found[3] == brute(listed, listed[3][3], 10, lambda row: row[0] % 2 == 1)
    assert found[4] == brute(listed, listed[4][3], 10)


def test_mixed_dimensions_are_refused(spark):
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0])], "qid bigint, vector array<float>")
    rows = spark.createDataFrame([(1, "a", 1, [1.0, 0.0])], SHAPE)
    with pytest.raises(NavigationError) as caught:
        nearest(rows, asked, 5)
    assert caught.value.code == "EMBEDDING_DIMENSION_MISMATCH"


@pytest.mark.parametrize("block", [1, 4096])
def test_mixed_dimensions_are_one_error_on_both_paths(spark, block):
    rows = [(0, "a", 1, [1.0, 0.0]), (1, "b", 1, [1.0, 0.0, 0.0])]
    passages = spark.createDataFrame(rows, SHAPE).coalesce(1)
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "qid bigint, vector array<float>")
    with pytest.raises(Exception, match="differ in dimension"):
        nearest(passages, asked, 2, block).collect()
