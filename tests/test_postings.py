import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.config import SearchConfig
from lodestone.functions.text import search_terms
from lodestone.operators.lexicon import with_lexical_columns
from lodestone.operators.postings import best_keywords, invert, keyword_scores, query_phrases
from lodestone.plans.search import read_requests, route_batch

TEXTS = [
    ("Cold start", "gpu scheduler cold scale out gpu-warmup-42"),
    ("Überblick", "Der Scheduler läuft; scale-out über GPU"),
    ("Out scale", "zeta out of scale reporting"),
    ("", "the quick brown fox"),
    ("Réseau", "le réseau est prêt, resume résumé"),
    ("冷启动", "GPU 冷启动 延迟"),
    ("Cold", "cold cold cold start_up startUp"),
] + [("Filler", f"filler text number {i} the") for i in range(9)]
QUERIES = ["scale-out", "gpu warmup", "reseau", "résumé cold", "the", "冷启动 GPU", "gpu-warmup-42"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, f"p{i % 3}/{i}.md", 1, [h] if h else [], c) for i, (h, c) in enumerate(TEXTS)]
    frame = spark.createDataFrame(
        rows, "chunk_id bigint, display_path string, start_line int, heading array<string>, content string"
    )
    return with_lexical_columns(frame).cache()


def test_scores_equal_the_embedded_engine(spark, index):
    """An independent full-text engine over the same stored term lists."""
    base = sqlite3.connect(":memory:")
    base.execute(
        "CREATE VIRTUAL TABLE t USING fts5(h, c, tokenize='unicode61 remove_diacritics 2')"
    )
    for row in index.collect():
        base.execute(
            "INSERT INTO t(rowid, h, c) VALUES (?, ?, ?)",
            (row.chunk_id + 1, " ".join(row.heading_terms), " ".join(row.content_terms)),
        )
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "qid bigint, query string")
    asked = asked.withColumn("terms", search_terms(F.col("query")))
    found = keyword_scores(invert(index), query_phrases(asked)).collect()
    ours = {(r.qid, r.chunk_id): r.score for r in found}
    theirs = {}
    for row in asked.collect():
        if not row.terms:
            continue
        match = " OR ".join(f'"{term}"' for term in row.terms)
        for rowid, score in base.execute(
            "SELECT rowid, bm25(t, 4.0, 1.0) FROM t WHERE t MATCH ?", (match,)
        ):
            theirs[(row.qid, rowid - 1)] = score
    assert ours.keys() == theirs.keys() and len(ours) > 15
    assert all(abs(ours[key] - theirs[key]) < 1e-9 for key in ours)


def test_equal_scores_are_ordered_by_path(spark, index):
    asked = spark.createDataFrame([(0, ["filler"])], "qid bigint, terms array<string>")
    rows = best_keywords(invert(index), query_phrases(asked), 5).orderBy("keyword_rank").collect()
    assert [r.keyword_rank for r in rows] == [1, 2, 3, 4, 5]
    paths = [r.display_path for r in rows]
    assert paths == sorted(f"p{i % 3}/{i}.md" for i in range(7, 16))[:5]


def test_filter_leaves_statistics_alone(spark, index):
    allowed = index.select("chunk_id", F.when(F.col("chunk_id") < 3, F.array(F.lit(0))).otherwise(
        F.array().cast("array<int>")).alias("scopes"))
    asked = spark.createDataFrame([(0, ["scale"])], "qid bigint, terms array<string>")
    phrases = query_phrases(asked)
    stored = invert(index)
    plain = {r.chunk_id: r.score for r in keyword_scores(stored, phrases).collect()}
    kept = keyword_scores(stored, phrases.withColumn("scope", F.lit(0)), allowed).collect()
    assert {r.chunk_id: r.score for r in kept} == {k: v for k, v in plain.items() if k < 3}


@pytest.mark.parametrize(
    "query,top,code", [(" \n", None, "QUERY_EMPTY"), (None, 5, "QUERY_EMPTY"), ("a", 0, "TOP_INVALID"), ("a", 101, "TOP_INVALID")]
)
def test_requests_of_a_frame_are_checked(spark, query, top, code):
    shape = "qid bigint, query string, query_parts array<string>, top int"
    asked = spark.createDataFrame([(1, "fine", None, 100), (2, query, None, top)], shape)
    with pytest.raises(Exception, match=f"{code}: request 2"):
        read_requests(asked, SearchConfig()).collect()


def test_many_requests_over_a_stored_index(spark, index):
    asked = spark.range(1000).selectExpr("id as qid", "concat('filler ', id % 20) as query")
    full = index.withColumn("end_line", F.lit(1)).withColumn("embedding", F.lit(None).cast("array<float>"))
    routes = route_batch(full, asked, SearchConfig(), inverted=invert(index))
    found = routes.candidates.groupBy("qid").count().collect()
    assert len(found) == 1000


def test_index_of_asked_tokens_ranks_like_the_whole(spark, index):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "qid bigint, query string")
    phrases = query_phrases(asked.withColumn("terms", search_terms(F.col("query"))))
    tokens = phrases.select(F.explode(F.split("phrase", " ")).alias("token"))
    whole, part = invert(index), invert(index, tokens.unionByName(tokens))
    ranked = [
        sorted(map(tuple, best_keywords(stored, phrases, 5).collect())) for stored in (whole, part)
    ]
    assert ranked[0] == ranked[1] and ranked[0]
    assert (part.passages, part.tokens) == (whole.passages, whole.tokens)
    assert part.blocks.count() < whole.blocks.count()
    assert invert(index, tokens.limit(0)).blocks.count() == 0
