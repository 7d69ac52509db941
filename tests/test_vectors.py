import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import tokens, vectors
from lodestone.operators.corpus import vector_problems


def test_pooling(spark):
    hidden = [[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]]
    frame = spark.createDataFrame([(hidden, [1, 1, 0])], "h array<array<double>>, m array<int>")
    pooled = frame.select(vectors.mean_pooled(F.col("h"), F.col("m")).alias("v")).first().v
    assert pooled == pytest.approx([math.sqrt(0.5)] * 2)
    none = frame.select(vectors.mean_pooled(F.col("h"), F.array(*[F.lit(0)] * 3)).alias("v"))
    assert none.first().v is None
    first = spark.createDataFrame([([[3.0, 4.0], [9.0, 9.0]],)], "h array<array<double>>")
    assert first.select(vectors.first_token_pooled(F.col("h")).alias("v")).first().v == [0.6, 0.8]


def test_truncation_and_padding(spark):
    frame = spark.createDataFrame([(list(range(9)), [1, 2])], "a array<bigint>, b array<bigint>")
    row = frame.select(
        tokens.head_and_tail(F.col("a"), 6, 99).alias("cut"),
        tokens.head_and_tail(F.col("b"), 6, 99).alias("short"),
        tokens.head_and_tail_static(F.col("a"), 5).alias("plain"),
        tokens.padded(F.col("b"), F.lit(3), 0).alias("padded"),
        tokens.attention_mask(F.col("b"), F.lit(3)).alias("mask"),
    ).first()
    assert list(row.cut) == [0, 1, 2, 99, 7, 8] and list(row.short) == [1, 2]
    assert list(row.plain) == [0, 1, 2, 7, 8]
    assert (list(row.padded), list(row["mask"])) == ([1, 2, 0], [1, 1, 0])


def test_vector_rules(spark):
    rows = [
        (0, [0.6, 0.8]),
        (1, [1.0]),
        (2, [float("nan"), 1.0]),
        (3, [0.5, 0.5]),
        (4, []),
        (5, [float("inf"), 0.0]),
    ]
    frame = spark.createDataFrame(rows, "id int, embedding array<float>")
    found = {r.id: r.problem for r in vector_problems(frame, 2).collect()}
    assert found == {
        0: "ok", 1: "dimension", 2: "not-finite", 3: "not-normalized", 4: "empty", 5: "not-finite",
    }


def test_truncated_vector_is_unit(spark):
    frame = spark.createDataFrame([([3.0, 4.0, 9.0],)], "v array<double>")
    assert frame.select(vectors.truncated(F.col("v"), 2).alias("v")).first().v == [0.6, 0.8]
    assert frame.select(vectors.truncated(F.col("v"), 4).alias("v")).first().v is None
