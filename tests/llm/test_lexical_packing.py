import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import lexical_packing as lp
from lodestone.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def _library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_every_token_is_its_own_encoding():
    """Then merging by the rank of the merged token is merging by the list of merges."""
    library = _library()
    for token, i in library.get_vocab().items():
        if i != 50256:
            assert [t.id for t in library.model.tokenize(token)] == [i]


def test_both_encoders_agree_on_characters():
    library, coder = _library(), lp.byte_coder(None, None)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)} ." for c in points[::7]]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert coder.encode(text).tolist() == e.ids


def test_special_strings():
    text = "it's <|endoftext|> here"
    assert lp.byte_coder(None, None).encode(text).tolist() == _library().encode(text).ids


def _check(rows, texts):
    """Every id lies in one piece, sequences have no gaps, padding is nothing."""
    library, coder = _library(), {}
    ids = {
        k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, t in texts.items()
    }
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_document[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_document) == set(ids) and not coder
    for k, pieces in by_document.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            part = ids[k][at : at + p["length"]]
            assert p["start"] == at and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            assert p["doc_tokens"] == len(ids[k])
            at += p["length"]
        assert at == len(ids[k])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and at & (at - 1) == 0


def test_query(spark, sample_documents):
    rows = QUERIES["op2_retrieval_packing"](spark, FOLDER).collect()
    _check(rows, dict(sample_documents))


def test_odd_documents(spark, documents_of):
    texts = [None, "", "x", "word " * 3000, "<|endoftext|>", "same words here", "same words here"]
    docs = documents_of(texts).repartition(1)
    _check(lp.pack_documents(docs, shard_docs=3).collect(), dict(enumerate(texts)))
    assert lp.pack_documents(docs.limit(0)).count() == 0


def test_neighbours_share_rare_words():
    texts = ["the cat zyx", "the dog", "zyx again the", "the the the", "nothing"]
    index = lp.ShardIndex(texts)
    unused = np.array([False, True, True, True, True])
    assert index.neighbours(0, unused).tolist()[0] == 2
    assert 4 not in index.neighbours(0, unused)
    assert 2 not in index.neighbours(0, unused & (np.arange(5) != 2))


def test_scores_are_bm25():
    texts = ["a b b c", "b c d", "a a a", "e f"]
    index = lp.ShardIndex(texts)
    n, lengths = 4, [4, 3, 3, 2]
    average = sum(lengths) / n

    def bm25(query, d):
        words = texts[d].split()
        total = 0.0
        for w in set(query.split()):
            df = sum(w in t.split() for t in texts)
            tf = words.count(w)
            idf = np.log1p((n - df + 0.5) / (df + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / average)) if df > 1 else 0
        return total

    expected = sorted((d for d in (1, 2, 3) if bm25(texts[0], d)), key=lambda d: -bm25(texts[0], d))
    assert index.neighbours(0, np.array([False, True, True, True])).tolist() == expected


def test_a_document_seeds_the_next_window():
    packer = lp.Packer(0, window=8)
    ids = [np.arange(13, dtype=np.uint32), np.arange(3, dtype=np.uint32), np.arange(20, dtype=np.uint32)]
    rows = list(packer.pack([0, 1, 2], ids, ["a b", "b", "c"])) + list(packer.finish())
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in rows] == [
        (0, 0, 8, 0, 0), (0, 8, 5, 1, 0), (1, 0, 3, 1, 5), (2, 0, 8, 2, 0), (2, 8, 8, 3, 0), (2, 16, 4, 4, 0),
    ]


def test_related_documents_meet_wherever_they_lie(spark, documents_of):
    """Each pair shares one word; its halves lie in different partitions, over a shard apart."""
    texts = [f"pair{i % 40} only{i} " + "the and of " * 20 for i in range(80)]
    docs = documents_of(texts).repartitionByRange(4, "doc_id")
    rows = lp.pack_documents(docs, window=256, shard_docs=8, range_chars=2500).collect()
    windows = defaultdict(set)
    for r in rows:
        windows[r["doc_id"]].add(r["sequence_id"])
    assert len({r["sequence_id"] >> 40 for r in rows}) > 1
    together = sum(bool(windows[i] & windows[i + 40]) for i in range(40))
    assert together >= 20


def test_many_texts_of_one_key_are_split(spark, documents_of):
    docs = documents_of(["the same words"] * 400)
    parts = lp.by_lexical_key(docs, 700).rdd.glom().map(len).collect()
    assert sum(parts) == 400 and max(parts) < 200


def test_neighbours_are_all_documents_with_a_shared_word():
    words = " ".join(f"w{i}" for i in range(60))
    index = lp.ShardIndex([words, *[f"w{i} x{i}" for i in range(60)], "none"])
    unused = np.arange(62) > 0
    assert sorted(index.neighbours(0, unused).tolist()) == list(range(1, 61))


def test_the_windows_seed_stays_the_query():
    """Its neighbours end after two documents; the last one's do not follow."""
    texts = ["a b", "z y", "a q", "b", "q q", "z"]
    ids = [np.arange(2, dtype=np.uint32) for _ in texts]
    rows = list(lp.Packer(0, window=8).pack(list(range(6)), ids, texts))
    assert [r[0] for r in rows] == [0, 3, 2, 1]


ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\tb c", "a \t b", "line one\nline two\n\n three", "\u00a0wide\u2003space \u3000 x",
    "x \u00a0y", "a\x1cb \x1c c", "a\x85 b", "nul\0 \0nul \0", "it's we'll 's 'S", "\u0130stanbul \u039f\u0394\u039f\u03a3 \u03a3 a\u03a3", "\u65e5\u672c\u8a9e\u3000\u6587\u7ae0 " * 30,
    "a <|endoftext|> b", "x<|endoftext|>", "long" * 40 + " " + "long" * 40, "W" * 33 + " w" + "w" * 31, "e\u0301 \u00e9 \u00c9 \U0001f600\U0001f600 1234 5,6", "same words", "Same WORDS same words",
]


def test_texts_are_read_as_the_library_reads_them():
    library, coder = _library(), lp.byte_coder(None, None)
    ids, words = lp.read_texts(coder, ODD)
    for text, found in zip(ODD, ids, strict=True):
        assert found.tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], repr(text)
    numbers: dict[str, int] = {}
    expected = [numbers.setdefault(w, len(numbers)) for t in ODD for w in t.lower().split()]
    assert [len(w) for w in words] == [len(t.lower().split()) for t in ODD]
    assert lp._in_order(np.concatenate(words)).tolist() == expected


def test_what_texts_share_is_encoded_once(monkeypatch):
    coder, seen = lp.byte_coder(None, None), []
    spaced, alone = coder.encode_spaced, coder.encode
    monkeypatch.setattr(coder, "encode_spaced", lambda words: seen.extend(words) or spaced(words))
    monkeypatch.setattr(coder, "encode", lambda text: seen.append(text) or alone(text))
    lp.read_texts(coder, [f"the same long words again and again {i % 3}" for i in range(300)])
    assert len(seen) == 300 + 9 and sum(map(len, seen)) < 1100


def _bins_of(text):
    words = set(text.lower().split())
    return sorted(zlib.crc32(w.encode()) % (lp.WORD_BINS - 1) + 1 for w in words)


def test_bins_are_of_the_words_crc():
    letters = "ab\u00e9\u0416\u65e5\U0001f600"
    texts = [*ODD, " ".join((letters * 20)[i % 6 :][:n] for i in range(3) for n in range(1, 80))]
    bins, held = lp.word_bins(texts)
    for text, found in zip(texts, np.split(bins, np.cumsum(held)[:-1]), strict=True):
        assert sorted(found.tolist()) == _bins_of(text), repr(text)


def test_documents_of_words_are_counted(spark, documents_of):
    texts = [*ODD, None] * 3
    counts, rows, chars = lp.word_documents(documents_of(texts).repartition(5))
    expected = np.zeros(lp.WORD_BINS, np.int64)
    for text in texts:
        np.add.at(expected, _bins_of(text or ""), 1)
    expected[expected == 1] = 0
    expected[0] = len(texts)
    assert (counts == expected).all() and rows == len(texts) and chars == sum(len(t or "") for t in texts)


def test_keys_name_the_rarest_words_of_each_level(monkeypatch):
    monkeypatch.setattr(lp, "LEVELS", (6, 3, 2))
    texts = ["a b", "a c", "a c", "", "a c d", "a b d", "a", " \n"]
    documents = np.zeros(lp.WORD_BINS, np.int64)
    for text in texts:
        documents[_bins_of(text)] += 1
    for text, key in zip(texts, lp.lexical_keys(texts, documents).tolist(), strict=True):
        ranked = sorted((documents[b], b) for b in _bins_of(text))
        named = [next((b for n, b in ranked if n >= least), 0) for least in lp.LEVELS]
        assert key == (named[0] * lp.WORD_BINS + named[1]) << 12 | named[2] & 0xFFF


def test_words_known_as_keys_make_the_same_index():
    texts = [f"w{i % 7} w{i % 5} w{i % 3} every one {'again ' * (i % 4)}" for i in range(60)]
    words = lp.read_texts(lp.byte_coder(None, None), texts)[1]
    unused = np.ones(60, bool)
    for seed in range(0, 60, 7):
        one, other = lp.ShardIndex(texts), lp.ShardIndex([], words)
        unused[: seed + 1] = False  # from half on, postings of used documents go
        expected = one.neighbours(seed, np.ones(60, bool))
        expected = expected[unused[expected]].tolist()
        assert [*other.best_first(seed, unused)] == expected and len(expected) == 59 - seed


def test_equal_keys_by_chance_are_told_apart():
    keys = np.array([5, 5 + (1 << 62), 5, 7, 5 + (1 << 62)])  # the same without their high bits
    assert lp._in_order(keys).tolist() == [0, 1, 0, 2, 1]
