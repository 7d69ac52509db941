import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.corpus import corpus_fingerprint, length_buckets, located
from lodestone.operators.ranking import even_sample, global_position, nearest_rank, top_k


def test_global_position_counts_every_row_once(spark):
    words = [f"w{i % 97:03d}-{i}" for i in range(3000)]
    random.Random(1).shuffle(words)
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    found = global_position(frame, ["word"]).collect()
    assert [r.word for r in sorted(found, key=lambda r: r.position)] == sorted(words)
    assert sorted(r.position for r in found) == list(range(3000))


@pytest.mark.parametrize("limit", [1, 3, 7, 10, 11])
def test_even_sample(spark, limit):
    frame = spark.range(10).select(F.col("id").alias("n"))
    found = sorted(r.n for r in even_sample(frame, ["n"], limit).collect())
    wanted = [i * 10 // limit for i in range(limit)] if limit < 10 else list(range(10))
    assert found == wanted


def test_nearest_rank_per_group_with_a_hot_value(spark):
    rng = random.Random(2)
    rows = [("a", float(v)) for v in (40, 10, 30, 20)]
    rows += [("b", 5.0)] * 400 + [("b", round(rng.random() * 10, 2)) for _ in range(800)]
    frame = spark.createDataFrame(rows, "kind string, value double")
    found = {
        r.kind: r
        for r in nearest_rank(frame, "kind", "value", {"p50": 0.5, "p95": 0.95, "top": 1.0}).collect()
    }
    assert (found["a"].p50, found["a"].p95, found["a"].n) == (20.0, 40.0, 4)
    ordered = sorted(v for k, v in rows if k == "b")
    for name, ratio in (("p50", 0.5), ("p95", 0.95), ("top", 1.0)):
        assert found["b"][name] == ordered[math.ceil(len(ordered) * ratio) - 1]
    empty = nearest_rank(frame.filter("value < 0"), "kind", "value", {"p50": 0.5})
    assert empty.count() == 0


def test_top_k_with_and_without_salt(spark):
    frame = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("g"), F.col("id")
    )
    plain = top_k(frame, ["g"], [F.desc("id")], 4).collect()
    salted = top_k(frame, ["g"], [F.desc("id")], 4, salt=F.col("id")).collect()
    assert sorted(plain) == sorted(salted) and len(plain) == 20


def test_length_buckets(spark):
    texts = [(0, "long text here"), (1, "a"), (2, "same"), (3, "size")]
    frame = spark.createDataFrame(texts, "id int, text string")
    found = length_buckets(frame, "id", "text", 2).collect()
    placed = sorted(found, key=lambda r: r.position)
    assert [r.id for r in placed] == [1, 2, 3, 0]
    assert [r.batch for r in placed] == [0, 0, 1, 1]


def test_fingerprint(spark):
    import hashlib

    rows = [(i, f"p{i % 4}", i, f"h{i}") for i in range(40)]
    frame = spark.createDataFrame(
        rows, "chunk_id bigint, display_path string, ordinal int, content_hash string"
    )
    hashes = [hashlib.sha256(f"{r[1]}:{r[2]}:{r[0]}:{r[3]}".encode()).digest() for r in rows]
    words = [sum(int.from_bytes(h[4 * i : 4 * i + 4]) for h in hashes) % 2**32 for i in range(8)]
    body = f"total:40\nselected:40\n{','.join(map(str, words))}"
    plain = hashlib.sha256(body.encode()).hexdigest()
    for parts in (1, 3, 17):
        found = corpus_fingerprint(frame.repartition(parts)).first()
        assert (found.fingerprint, found.chunks) == (plain, 40)
    other = frame.withColumn("content_hash", F.when(F.col("chunk_id") == 3, "x").otherwise(F.col("content_hash")))
    assert corpus_fingerprint(other).first().fingerprint != plain
    empty = corpus_fingerprint(frame.limit(0)).first()
    assert empty.chunks == 0 and empty.fingerprint


def test_missing_location_is_an_error(spark):
    place = "display_path string, start_line int, end_line int"
    chunks = spark.createDataFrame([("a", 1, 2, 7)], place + ", chunk_id bigint")
    results = spark.createDataFrame([("a", 1, 2)], place)
    assert located(results, chunks).first().chunk_id == 7
    lost = spark.createDataFrame([("a", 1, 3)], place)
    with pytest.raises(Exception, match="absent from the corpus: a:1:3"):
        located(lost, chunks).collect()
