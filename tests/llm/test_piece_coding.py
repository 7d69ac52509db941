import hashlib
import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import piece_coding as pc
from lodestone.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    "", " ", "  a", " a b  c ", "a\n\nb\t c", "日本語 text 🎉🎉", "▁x ▁▁ y", "a" * 300, "  ", "\n",
    "<s> </s> <unk> <0x41>", "x\0y", "   leading and trailing   ", "Ā" * 50, "ab" * 5000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pc.model_path())


@pytest.fixture(scope="module")
def model():
    return pc.PieceModel(pc.model_path())


def _same(model, library, text):
    ids, spans, decoded = model.encode(text)
    proto = library.encode(text, return_type="proto")
    assert ids.tolist() == [p.id for p in proto.pieces]
    assert [tuple(s) for s in spans.tolist()] == [(p.begin, p.end) for p in proto.pieces]
    assert decoded == model.decode([1, *ids.tolist(), 2]) == library.decode(ids.tolist())


@pytest.mark.parametrize("text", TEXTS)
def test_ids_spans_and_decoding_equal_the_library(model, library, text):
    _same(model, library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    _same(pc.piece_model(pc.model_path()), _library(), text)


def _library(found=[]):  # noqa: B006
    if not found:
        found.append(sentencepiece.SentencePieceProcessor(model_file=pc.model_path()))
    return found[0]


def test_a_full_memory_changes_nothing(library):
    small = pc.PieceModel(pc.model_path(), memory=3)
    for text in TEXTS:
        _same(small, library, text)


def test_bytes_that_are_no_text(model, library):
    ids = [1] + [model._bytes[b] for b in (0xE6, 0x41, 0xFF, 0xC3, 0xA9)] + [2]
    assert model.decode(ids) == library.decode(ids)


def _compiled(pairs):
    """A character map of a few prefixes, laid out without sharing."""
    pool, offsets = b"", {}
    for key, value in pairs.items():
        offsets[key] = len(pool)
        pool += value + b"\0"
    units = [0] * 4096
    base = {b"": 256}
    units[0] = (256 << 10)
    free = 512
    nodes = sorted({k[:i] for k in pairs for i in range(1, len(k) + 1)}, key=len)
    for prefix in nodes:
        at = base[prefix[:-1]] ^ prefix[-1]
        base[prefix] = free
        units[at] = prefix[-1] | (at ^ free) << 10 | (prefix in pairs) << 8
        if prefix in pairs:
            units[free] = 0x80000000 | offsets[prefix]
        free += 256
    data = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(data)) + data + pool


def test_longest_prefixes_are_replaced_and_aligned(model):
    mapped = pc.CharacterMap(_compiled({b"ab": b"X", b"abc": b"YZ", "é".encode(): b"e", b"q": b""}))
    assert mapped.longest(b"abcd", 0) == (3, b"YZ")
    assert mapped.longest(b"abd", 0) == (2, b"X")
    assert mapped.longest(b"zab", 0) is None
    other = pc.PieceModel(pc.model_path())
    other.map = mapped
    normal, places = other.normalise("abcé qd")
    assert normal == "▁YZe▁d"
    assert places.tolist() == [0, 0, 0, 0, 0, 3, 5, 5, 5, 7, 8]
    ids, spans, _ = other.encode("abcé qd")
    assert spans[0][0] == 0 and spans[-1][1] == 8
    assert (np.diff(spans.ravel()) >= 0).all()


def test_squeezed_white_space():
    other = pc.PieceModel(pc.model_path())
    other._squeeze = True
    normal, places = other.normalise("  a   b ")
    assert normal == "▁a▁b"
    assert places.tolist() == [2, 2, 2, 2, 3, 3, 3, 6, 7]


def test_query(spark, sample_documents, library):
    got = {r["doc_id"]: r for r in QUERIES["op1_piece_coding"](spark, FOLDER).collect()}
    assert len(got) == len(sample_documents)
    for doc_id, text in sample_documents:
        ids = [1, *library.encode(text), 2]
        row = got[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_frame_of_odd_rows(spark, documents_of):
    docs = documents_of([None, "", "a b", (None, "a b"), (2, "a b")])
    rows = pc.encode_pieces(docs.withColumnRenamed("lang", "ids")).collect()
    assert sorted((r["doc_id"] is None, len(r["ids"]), r["decoded"]) for r in rows) == [
        (False, 2, ""), (False, 2, ""), (False, 4, "a b"), (False, 4, "a b"), (True, 4, "a b"),
    ]
    assert pc.piece_digests(docs.limit(0)).count() == 0
