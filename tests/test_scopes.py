"""Filters of a batch against each filter by itself."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import scopes
from lodestone.operators.scopes import number_scopes, scope_condition, with_scopes

PASSAGES = (
    "chunk_id bigint, display_path string, start_line int, collection_id string, source_id string, "
    "source_tags array<string>, document_tags array<string>"
)
FILTERS = "qid bigint, path string, collection_ids array<string>, source_ids array<string>, tags array<string>"
NAMES = ["docs", "API", "guide", "ünï", "a_b", "x%y", "z"]


def _passages(spark, rng, count=120):
    def tags():
        return rng.choice([None, [], rng.sample(["red", "Blue", "GREEN", "x"], rng.randint(1, 3))])

    rows = [
        (i, rng.choice(["/", "\\"]).join(rng.choices(NAMES, k=3)) + f"/{i}.md", 1, rng.choice(["c1", "c2", None]),
         rng.choice(["s1", "s2", "s3"]), tags(), tags())
        for i in range(count)
    ]
    return spark.createDataFrame(rows, PASSAGES)


def _filters(rng, count):
    def some(names):
        return rng.choice([None, [], rng.choices(names, k=rng.randint(1, 3))])

    return [
        (q, rng.choice([None, "", "./docs", "API\\\\".replace("\\\\", "\\"), "NÏ", "_b", "%", f"{q % 60}.md", "nowhere"]),
         some(["c1", "c2", "c9"]), some(["s1", "s2", "s9"]), some(["RED", "blue", "none"]))
        for q in range(count)
    ]


@pytest.mark.parametrize("few", [32, 0])
def test_scopes_equal_each_filter_by_itself(spark, monkeypatch, few):
    monkeypatch.setattr(scopes, "FEW_PATHS", few)
    rng = random.Random(few)
    passages, filters = _passages(spark, rng).cache(), _filters(rng, 60)
    numbered, table = number_scopes(spark.createDataFrame(filters, FILTERS))
    scope_of = {r.qid: r.scope for r in numbered.collect()}
    held = {}
    for row in with_scopes(passages, table).select("chunk_id", "scopes").collect():
        assert len(row.scopes) == len(set(row.scopes))
        for scope in row.scopes:
            held.setdefault(scope, set()).add(row.chunk_id)
    everything = {r.chunk_id for r in passages.select("chunk_id").collect()}
    for qid, *wanted in filters:
        condition = scope_condition(*wanted)
        kept = passages if condition is None else passages.where(F.coalesce(condition, F.lit(False)))
        expected = {r.chunk_id for r in kept.select("chunk_id").collect()} if qid < 25 else None
        if expected is not None:
            assert held.get(scope_of[qid], set()) == expected, (qid, wanted)
    assert len(everything) == 120


def test_requests_without_filters_share_one_scope(spark):
    asked = spark.createDataFrame([(1, None, None, [], None), (2, "", [], None, [])], FILTERS)
    numbered, table = number_scopes(asked)
    assert table is None and {r.scope for r in numbered.collect()} == {0}
    passages = _passages(spark, random.Random(1), 5)
    assert {tuple(r.scopes) for r in with_scopes(passages, table).collect()} == {(0,)}


def test_a_thousand_filters_in_one_pass(spark):
    rng = random.Random(9)
    passages = _passages(spark, rng, 300)
    asked = [(q, f"/{q}.md", ["c1"] if q % 2 else None, None, None) for q in range(1000)]
    numbered, table = number_scopes(spark.createDataFrame(asked, FILTERS))
    assert table.count() == 1000
    scope_of = {r.qid: r.scope for r in numbered.collect()}
    held = {r.chunk_id: set(r.scopes) for r in with_scopes(passages, table).collect()}
    for row in passages.collect():
        q = row.chunk_id
        assert held[q] == ({scope_of[q]} if q % 2 == 0 or row.collection_id == "c1" else set())
