from pyspark.sql import functions as F

from lodestone.config import SearchConfig
from lodestone.functions.scoring import total_weight
from lodestone.functions.text import index_terms
from lodestone.operators.fusion import (
    fuse_routes,
    rank_results,
    score_candidates,
    with_relaxation,
    with_text_evidence,
)

ROUTE = "qid bigint, chunk_id bigint, path string, rank int, content string, distance double"


def fuse(spark, vector, keyword, terms, relaxed=False, top=5):
    """Rank candidates given as ``(id, path, rank, content, distance)``."""
    left = spark.createDataFrame([(0, *row) for row in vector], ROUTE)
    right = spark.createDataFrame([(0, *row, None) for row in keyword], ROUTE)
    payload = left.unionByName(right).dropDuplicates(["chunk_id"])
    fused = fuse_routes(
        left.withColumnRenamed("rank", "vector_rank"),
        right.withColumnRenamed("rank", "keyword_rank"),
    )
    rows = fused.join(payload.select("chunk_id", "path", "content"), "chunk_id").select(
        "*",
        F.col("path").alias("display_path"),
        F.lit(10).alias("start_line"),
        index_terms(F.concat(F.lit("Heading "), "content")).alias("indexed_terms"),
        F.lit("natural").alias("mode"),
        F.array(*[F.lit(t) for t in terms]).alias("terms"),
        F.lit(None).cast("array<array<string>>").alias("part_terms"),
        F.lit(top).cast("int").alias("top"),
    )
    rows = rows.withColumn("terms_weight", total_weight(F.col("terms")))
    config = SearchConfig()
    scored = score_candidates(
        with_text_evidence(rows, 100).withColumn("relaxed", F.lit(relaxed)), config
    )
    return rank_results(scored).orderBy("rank").collect()


RELEVANT = "Useful passage"


def test_both_routes_promote(spark):
    found = fuse(
        spark,
        [(1, "near.md", 1, RELEVANT, 0.1), (2, "twice.md", 2, RELEVANT, 0.11)],
        [(2, "twice.md", 1, RELEVANT), (3, "word.md", 2, RELEVANT)],
        ["useful"],
    )
    assert found[0].path == "twice.md" and found[0].reason == "signal"
    # 0.6 * rrf + 0.2 * lexical + 0.2 * semantic by hand
    rrf = (0.45 / 10 + 0.55 / 9) / (1 / 9)
    lexical = (1 - 2.718281828459045 ** (-4 / 3)) ** 0.5
    wanted = 0.6 * rrf + 0.2 * lexical + 0.2 * (0.15 - 0.11) / 0.06
    assert abs(found[0].score - wanted) < 1e-12


def test_exact_keyword_outranks_weak_semantics(spark):
    exact = "Token bucket limits"
    found = fuse(
        spark,
        [(1, "near.md", 1, "Other things", 0.13), (2, "named.md", 60, exact, 0.17)],
        [(2, "named.md", 1, exact)],
        ["token", "bucket"],
    )
    assert found[0].path == "named.md"


def test_no_credible_signal_is_rejected(spark):
    text = "Table of pages"
    assert (
        fuse(
            spark,
            [(1, "a.md", 1, text, 0.14)],
            [(1, "a.md", 1, text)],
            ["qwv-0000", "火星语言"],
        )
        == []
    )


def test_relaxed_terms_keep_bounded_weak_signals(spark):
    args = (
        [(1, "near.md", 1, "Other things", 0.2)],
        [(2, "word.md", 1, "gamma")],
        ["alpha", "beta", "gamma"],
    )
    found = fuse(spark, *args, relaxed=True)
    assert [(r.path, r.reason) for r in found] == [
        ("word.md", "term-keyword"),
        ("near.md", "term-vector"),
    ]
    assert fuse(spark, *args, relaxed=False) == []


def test_ties_end_in_path_and_top_is_optional(spark):
    tied = [(1, "b.md", 1, RELEVANT, 0.11), (2, "a.md", 1, RELEVANT, 0.11)]
    assert [r.path for r in fuse(spark, tied, [], ["useful"])] == ["a.md", "b.md"]
    many = [(i, f"{i}.md", i, RELEVANT, 0.1) for i in range(1, 8)]
    assert len(fuse(spark, many, [], ["useful"], top=None)) == 7
    assert len(fuse(spark, many, [], ["useful"], top=3)) == 3


def test_evidence_needs_two_parts_in_the_found_vocabulary(spark):
    rows = [
        (0, [["cache"], ["evict"], ["队列"]], ["cache", "队列"], True),
        (1, [["cache"], ["evict"], ["淘汰"]], ["cache", "队列"], False),
        (2, [["parser"]], ["parser"], True),
        (3, [["x1"], ["x2"]], ["cache"], False),
    ]
    frame = spark.createDataFrame(
        [(q, parts, words, "terms", 1, ["cache"], 4) for q, parts, words, _ in rows],
        "qid int, part_terms array<array<string>>, indexed_terms array<string>, mode string, "
        "keyword_rank int, terms array<string>, terms_weight int",
    )
    found = with_relaxation(with_text_evidence(frame, 100)).select("qid", "relaxed").collect()
    assert {r.qid: r.relaxed for r in found} == {q: wanted for q, _, _, wanted in rows}
