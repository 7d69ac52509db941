"""Rows of several media types through their parsers."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators.chunking import chunk_documents
from lodestone.operators.parsing import PARSERS, parse_documents, plain_sections

SHAPE = "k int, media_type string, content string"
TEXT = "# Title\n\nfirst line\nsecond line\n   \n\nlast"


def _chunks(frame):
    rows = frame.select("k", "ordinal", "heading", "start_line", "end_line", "content").collect()
    return sorted((r.k, r.ordinal, tuple(r.heading), r.start_line, r.end_line, r.content) for r in rows)


def test_each_row_goes_to_the_parser_of_its_type(spark):
    rows = [(0, "text/markdown", TEXT), (1, "text/plain", TEXT), (2, "text/plain", ""), (3, "text/markdown", None),
            (4, "text/plain", None), (5, "text/plain", " \n\t\n")]
    frame = spark.createDataFrame(rows, SHAPE)
    found = _chunks(parse_documents(frame, 12))
    assert [c for c in found if c[0] == 0] == _chunks(chunk_documents(frame.where("k = 0"), 12))
    assert [c for c in found if c[0] == 1] == [
        (1, 0, (), 1, 1, "# Title"), (1, 1, (), 3, 3, "first line"), (1, 2, (), 4, 4, "second line"), (1, 3, (), 7, 7, "last"),
    ]
    assert {c[0] for c in found} == {0, 1}


def test_plain_paragraphs_are_packed_up_to_the_limit(spark):
    frame = spark.createDataFrame([(0, "text/plain", TEXT)], SHAPE)
    assert [c[3:5] for c in _chunks(parse_documents(frame, 1000))] == [(1, 7)]


def test_an_unknown_type_is_an_error(spark):
    for kind in ("text/html", None):
        frame = spark.createDataFrame([(0, "text/plain", "a"), (1, kind, "a")], SHAPE)
        with pytest.raises(Exception, match="PARSER_NOT_FOUND"):
            parse_documents(frame).collect()


def test_a_parser_of_ones_own(spark):
    def shouting(content):
        return plain_sections(F.when(F.upper(content) == content, content).otherwise(F.lit("")))

    frame = spark.createDataFrame([(0, "text/loud", "LOUD"), (1, "text/loud", "quiet"), (2, "text/plain", "x")], SHAPE)
    found = _chunks(parse_documents(frame, parsers={**PARSERS, "text/loud": shouting}))
    assert [c[0] for c in found] == [0, 2]
