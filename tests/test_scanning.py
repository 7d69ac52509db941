"""Scores of a known batch, added up where the passages lie."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.catalog import frames
from lodestone.functions.text import index_tokens, rest_spaced, ascii_spaced, term_text
from lodestone.operators import postings, scanning
from lodestone.operators.lexicon import with_lexical_columns, with_terms

SHAPE = "chunk_id bigint, display_path string, start_line int, heading array<string>, content string"
WORDS = ["cache", "evict", "scale-out", "out", "scale", "Über", "ñandú", "api.Key", "key", "thread"]


def _passages(spark, ids):
    dice = random.Random(4)
    rows = []
    for n, key in enumerate(ids):
        text = " ".join(dice.choices(WORDS, k=dice.randint(0, 9))) if n % 11 else None
        heading = None if text is None else [WORDS[n % len(WORDS)]] if n % 3 else []
        rows.append((key, f"web/{n % 7}.md", 1 + n % 2, heading, text))
    return spark.createDataFrame(rows, SHAPE)


def _phrases(spark):
    asked = [(1, "cache evict"), (2, "scale-out"), (3, "über ñandú key absent"), (4, "api.Key thread out"), (4, "out")]
    told = with_terms(spark.createDataFrame(asked, "qid bigint, text string"), {"terms": F.col("text")})
    return postings.query_phrases(told)


def _listed(found):
    names = ("qid", "chunk_id", "display_path", "start_line", "score", "keyword_rank")
    return sorted((tuple(row[n] for n in names) for row in found.collect()), key=repr)


@pytest.mark.parametrize(
    ("ids", "cells", "k"),
    [(range(60), 40, 4), ([n % 23 for n in range(60)], scanning._CELLS, 50), ([n % 9 or None for n in range(40)], 12, 4)],
)
def test_scan_equals_the_inverted_index(spark, monkeypatch, ids, cells, k):
    monkeypatch.setattr(scanning, "_CELLS", cells)
    passages, phrases = _passages(spark, ids), _phrases(spark)
    index = postings.invert(with_lexical_columns(passages))
    tokens = phrases.select(F.explode(F.split("phrase", " ")).alias("token"))
    hits = scanning.count_asked(passages, tokens)
    assert (hits.count, hits.length) == (index.passages, index.tokens)
    assert _listed(scanning.scan_keywords(hits, phrases, k)) == _listed(postings.best_keywords(index, phrases, k))


def test_scan_in_blocks_of_requests(spark, monkeypatch):
    passages, phrases = _passages(spark, range(30)), _phrases(spark)
    hits = scanning.count_asked(passages, phrases.select(F.explode(F.split("phrase", " ")).alias("token")))
    whole = _listed(scanning.scan_keywords(hits, phrases, 5))
    monkeypatch.setattr(scanning, "REQUEST_BLOCK", 1)
    assert whole and _listed(scanning.scan_keywords(hits, phrases, 5)) == whole


def test_too_many_tokens_have_no_hits(spark, monkeypatch):
    monkeypatch.setattr(scanning, "MOST_TOKENS", 1)
    tokens = spark.createDataFrame([("a",), ("b",)], "token string")
    assert scanning.count_asked(_passages(spark, range(3)), tokens) is None


def test_searched_tables_write_neither_texts_nor_terms(spark, tmp_path, monkeypatch):
    folder, written = str(tmp_path), {}
    tables = {
        "documents": ("doc_id bigint, text string, lang string, source string", [(n, "some cache", "en", "web") for n in range(9)]),
        "embeddings": ("vec_id bigint, embedding array<float>, label int", [(0, [1.0], 1)]),
        "labels": ("doc_id bigint, quality int, toxic int", [(1, 1, 1)]),
        "benchmark": ("item_id bigint, text string", [(0, "cache")]),
    }
    for name, (shape, rows) in tables.items():
        spark.createDataFrame(rows, shape).write.parquet(os.path.join(folder, f"{name}.parquet"))

    def noted(df, label, plain=frames.materialize):
        written[label] = set(df.columns)
        return plain(df, label)

    monkeypatch.setattr(frames, "materialize", noted)
    monkeypatch.setattr(scanning, "materialize", noted)
    full, hits = frames.searched_passages(spark, folder), frames.asked_hits(spark, folder)
    assert full.count() == hits.count == 9 and hits.tokens == ["cache"]
    texts = {"content", "content_terms", "content_tokens", "heading_tokens"}
    assert written and not any(columns & texts for columns in written.values())


def test_signs_are_spaced_in_two_steps_as_in_one(spark):
    rows = [(t,) for t in ("a¿b ¡c! d", "ñ×÷ e_f/g:h-i", "ª²Ω漢字 x́y", "a—b “c” ſﬀ", "\x00\x7f~{}", " ", "", None)]
    told = spark.createDataFrame(rows, "t string").withColumn("p", ascii_spaced(F.col("t")))
    found = told.select(term_text(F.col("t")).alias("one"), rest_spaced(F.col("p")).alias("two")).collect()
    assert [r.one for r in found] == [r.two for r in found]


def test_number_of_tokens_does_not_depend_on_their_order(spark):
    rows = [("İstanbul x́ a.b-C camelCase éß ½ ﬁn",), ("z_y/x Ǆ",)]
    told = with_terms(spark.createDataFrame(rows, "t string"), {"o": F.col("t")})
    told = with_terms(told, {"u": F.col("t")}, ordered=False)
    for row in told.select(index_tokens(F.col("o")).alias("o"), index_tokens(F.col("u")).alias("u")).collect():
        assert sorted(row.o) == sorted(row.u)
