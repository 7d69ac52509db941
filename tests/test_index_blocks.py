"""Blocks, their bounds and the statistics of an index that is updated."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import postings
from lodestone.operators.lexicon import with_lexical_columns
from lodestone.operators.postings import (
    best_keywords,
    invert,
    keyword_scores,
    opened_blocks,
    query_phrases,
    rank_batch,
)
from lodestone.sources.store import MERGE_AT, IndexStore

WORDS = [f"w{i}" for i in range(60)] + ["left-right", "up_down", "alpha/beta"]


def _texts(seed, count):
    """Passages of words of very different frequency."""
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [" ".join(rng.choices(WORDS, weights, k=rng.randint(1, 60))) for _ in range(count)]


def _passages(spark, texts, first=0):
    rows = [(first + i, f"p{i % 5}/{i}.md", 1, [t.split()[0]], t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(
        rows, "chunk_id bigint, display_path string, start_line int, heading array<string>, content string"
    )
    return with_lexical_columns(frame)


def _asked(spark, queries):
    asked = [(i, q.split()) for i, q in enumerate(queries)]
    return query_phrases(spark.createDataFrame(asked, "qid bigint, terms array<string>"))


QUERIES = ["w0 w1 w50", "w40", "w3 left-right w9", "up_down alpha/beta", "w0", "w59 w58 w57 w0 w1 w2", "absent", "absent w7 w7"]


def _ordered(rows, k):
    best = {}
    for r in sorted(rows, key=lambda r: (r.qid, r.score, r.display_path, r.start_line, r.chunk_id)):
        best.setdefault(r.qid, []).append((r.chunk_id, r.score))
    return {q: found[:k] for q, found in best.items()}


@pytest.mark.parametrize("size,k", [(4, 3), (16, 10), (256, 5)])
def test_pruned_ranks_equal_those_of_all_scores(spark, monkeypatch, size, k):
    monkeypatch.setattr(postings, "BLOCK_IDS", size)
    monkeypatch.setattr(postings, "SEARCHED", 0)
    passages = _passages(spark, _texts(1, 300) + ["w0 w1 w50 w50"] * 20).cache()
    index, phrases = invert(passages), _asked(spark, QUERIES)
    expected = _ordered(keyword_scores(index, phrases).collect(), k)
    found = {}
    for r in best_keywords(index, phrases, k).orderBy("qid", "keyword_rank").collect():
        found.setdefault(r.qid, []).append((r.chunk_id, r.score))
    assert found == expected


def test_blocks_below_the_cutoff_stay_closed(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_IDS", 8)
    monkeypatch.setattr(postings, "SEARCHED", 0)
    monkeypatch.setattr(postings, "LEAD", 1)
    texts = ["common " * 3 + f"filler{i}" for i in range(400)]
    for i in range(0, 400, 40):
        texts[i] = "rare common"
    index = invert(_passages(spark, texts))
    ranking = rank_batch(index, _asked(spark, ["rare common"]), 5)
    assert ranking.cutoffs.count() == 1
    had, opened = opened_blocks(ranking)
    assert (had, opened) == (60, 20)  # 50 of the common word and 10 of the rare one
    assert {r.chunk_id for r in ranking.scores.collect()} == set(range(0, 400, 40))


def test_a_search_opens_the_asked_buckets_only(spark):
    index = invert(_passages(spark, _texts(2, 50)))
    plan = rank_batch(index, _asked(spark, ["w1"]), 5).scores._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet [token" in line]
    assert scans and all("bucket" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)
    assert all("PushedFilters" in s and "token" in s.split("PushedFilters")[1] for s in scans)


def test_a_word_of_every_passage_is_cut_by_ranges_of_ids(spark):
    index = invert(_passages(spark, ["same word"] * 2000))
    sizes = index.blocks.where("token = 'same'").select(F.size("at").alias("n")).collect()
    assert sum(r.n for r in sizes) == 2000 and max(r.n for r in sizes) <= postings.BLOCK_IDS


def test_overlapping_places_of_a_phrase_all_count(spark):
    rows = [(0, "p", 1, ["a"], "x a a a b".split(), 6), (1, "q", 1, ["a", "b"], ["a"], 3), (2, "r", 1, [], ["b", "a"], 2)]
    shape = "chunk_id long, display_path string, start_line int, heading_tokens array<string>, content_tokens array<string>, doc_len int"
    index = invert(spark.createDataFrame(rows, shape))
    asked = spark.createDataFrame([(0, ["a_a"]), (1, ["a_b"])], "qid bigint, terms array<string>")
    numbered = postings.number_phrases(query_phrases(asked))
    named = postings.phrase_hits(index, numbered).join(numbered.dictionary, "phrase_id")
    hits = {(r.phrase, r.chunk_id): r.hits for r in named.collect()}
    assert hits == {("a a", 0): 2, ("a b", 0): 1, ("a b", 1): 4}


def test_no_pairs_of_request_and_passage_are_shuffled(spark):
    index = invert(_passages(spark, _texts(2, 50)))
    plan = rank_batch(index, _asked(spark, QUERIES)).scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "hashpartitioning(qid" not in plan


def test_postings_move_once_without_what_follows_from_them(spark):
    plan = postings.blocks_of(_passages(spark, _texts(2, 50)), size=10**8)._jdf.queryExecution().executedPlan()
    exchanges = [line for line in plan.toString().splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and f", {-(-10**8 // postings.TASK_ROWS)})" in exchanges[0]
    below = plan.toString().split(exchanges[0])[1].splitlines()[1]
    assert "stripe" not in below and "bucket" not in below


def _joined_rows(frame):
    """Rows that the joins of a frame gave, when it was run."""
    frame.collect()
    total, left = 0, [frame._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(plan.plan())
        elif name.endswith("JoinExec"):
            total += plan.metrics().apply("numOutputRows").value()
        left += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_a_token_of_all_phrases_is_not_listed_for_each(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_IDS", 4)
    texts = [f"com_x{i}" for i in range(60)] + ["com com_x1 x2"] * 20 + ["rest com_com rest"]
    index = invert(_passages(spark, texts))
    phrases = [f"com_x{i}" for i in range(60)] + ["com_com", "com_x1_com", "x1_absent"]
    numbered = postings.number_phrases(_asked(spark, phrases))
    seen, write = [], postings.materialize

    def recorded(frame, label):
        if label == "phrase-candidates":
            seen.append(_joined_rows(frame))
        return write(frame, label)

    monkeypatch.setattr(postings, "materialize", recorded)
    named = postings.phrase_hits(index, numbered).join(numbered.dictionary, "phrase_id")
    hits = {}
    for r in named.collect():
        hits[r.phrase] = hits.get(r.phrase, 0) + 1
    sequences = [
        (" ".join(r.heading_tokens), " ".join(r.content_tokens)) for r in _passages(spark, texts).collect()
    ]
    expected = {}
    for phrase in {p.replace("_", " ") for p in phrases}:
        n = sum(any(f" {phrase} " in f" {part} " for part in parts) for parts in sequences)
        if n:
            expected[phrase] = n
    assert hits == expected and hits["com x1"] == 21
    # 60 phrases of "com", which 21 blocks hold, made 1,200 rows.
    assert len(seen) == 1 and seen[0] < 300


def _statistics(index):
    terms = index.terms.groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0").collect()
    return index.passages, index.tokens, {r.token: r.df for r in terms}


def _apply(store, current, fresh, gone_ids):
    """One update of the postings, as the store's commit makes it."""
    gone = current.where(F.col("chunk_id").isin(gone_ids))
    after = current.where(~F.col("chunk_id").isin(gone_ids)).unionByName(fresh)
    store.manifest = {**store.manifest, **store.add_segment(fresh, gone, after)}
    store.manifest["version"] += 1
    return after


def _index_of(store, passages):
    held = store.manifest
    dead = None
    if held["dead"]:
        dead = store.spark.read.parquet(*[f"{store.path}/{f}" for f in held["dead"]])
    folders = [f"{store.path}/{f}" for f in held["segments"]]
    return postings.read_segments(store.spark, folders, (held["passages"], held["tokens"]), passages, dead)


def test_statistics_and_ranks_after_updates_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SEARCHED", 0)
    store = IndexStore(spark, str(tmp_path / "index"))
    current = _passages(spark, _texts(3, 0) or ["w0"])
    current = _apply(store, current.limit(0), _passages(spark, _texts(4, 60)), [])
    assert store.manifest["passages"] == 60
    current = _apply(store, current, _passages(spark, _texts(5, 10), 100), [1, 2, 59])
    current = _apply(store, current, _passages(spark, _texts(6, 5), 200), [100])
    current = _apply(store, current, current.limit(0), [0])
    assert len(store.manifest["segments"]) == 4 and store.manifest["dead_chunks"] == 5
    updated, rebuilt = _index_of(store, current), invert(current)
    assert _statistics(updated) == _statistics(rebuilt)
    phrases = _asked(spark, QUERIES)
    for k in (3, 50):
        rows = [sorted(map(tuple, best_keywords(i, phrases, k).collect())) for i in (updated, rebuilt)]
        assert rows[0] == rows[1] and rows[0]


def test_segments_are_merged(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    current = _apply(store, _passages(spark, ["w0"]).limit(0), _passages(spark, ["w1 w2"] * 3), [])
    for i in range(MERGE_AT - 2):
        current = _apply(store, current, _passages(spark, [f"w{i}"], 10 + i), [])
    assert len(store.manifest["segments"]) == MERGE_AT - 1
    current = _apply(store, current, _passages(spark, ["w9"], 50), [0])
    assert len(store.manifest["segments"]) == 1 and store.manifest["dead"] == []
    assert _statistics(_index_of(store, current)) == _statistics(invert(current))
    current = _apply(store, current, current.limit(0), [1, 2, 10, 11])
    assert len(store.manifest["segments"]) == 1 and store.manifest["dead_chunks"] == 0
    assert _statistics(_index_of(store, current)) == _statistics(invert(current))
