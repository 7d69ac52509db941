import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import token_alignment as ta
from lodestone.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    path = public_tokenizers.path("byte_bpe_50k.json")
    a = Tokenizer.from_file(path)
    a.encode_special_tokens = True
    with open(path) as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    return (
        lambda x: a.encode(" " + x, add_special_tokens=False).ids,
        lambda i: bytes(letters[c] for c in names[i]),
        b.encode,
        piece,
    )


def _ends(ids, of):
    out, at = [], 0
    for i in ids:
        at += len(of(i))
        out.append(at)
    return out


def _groups(a, ends_a, b, ends_b):
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        last_a, last_b = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append("|".join(",".join(map(str, ids)) for ids in (a[i:last_a], b[j:last_b])))
        i, j = last_a, last_b
    return groups


def _brute(rows, libraries):
    """The contract, token by token, with the other library for A."""
    encode_a, bytes_a, encode_b, bytes_b = libraries
    parts, counts = [], Counter()
    for doc, text in rows:
        part = (doc, 0, 0, 0, 0, "", [])
        if text:
            a, b = encode_a(text), encode_b(text)
            source = (" " + text).encode()
            if b"".join(map(bytes_a, a)) == source == b"".join(map(bytes_b, b)):
                ends_a, ends_b = _ends(a, bytes_a), _ends(b, bytes_b)
                at_b = dict(zip(ends_b, b, strict=True))
                links = [(i, at_b[x]) for i, x in zip(a, ends_a, strict=True) if x in at_b]
                groups = _groups(a, ends_a, b, ends_b)
                digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
                part = (doc, len(a), len(b), len(groups), len(links), digest, links)
        parts.append(part)
        counts.update(part[6])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    figures = [
        (*part[:5], sum(counts[x] == most[x[1]] for x in part[6]), sum(counts[x] for x in part[6]), part[5])
        for part in parts
    ]
    return figures, {(a, b, n, n == most[b]) for (a, b), n in counts.items()}


def _same(got, expected):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


TEXTS = [
    (1, "The cat sat on the mat."), (2, "the the the the cat"), (3, ""), (4, None), (None, "the mat"),
    (5, "plain <s> and </s> and <|endoftext|> stay text"), (6, "a ▁ sign"), (7, "nul \x00 and tabs\t\t\r\n\n  x"),
    (8, "naïve 你好 😀 ع"), (9, "the cat sat"), (9, "the cat sat"), (9, "another of that id"), (10, " "), (11, "x" * 300),
]


@pytest.mark.parametrize(
    "sizes", [{}, {"run_records": 7, "fan": 2, "radices": 3, "salt_bytes": 64}, {"run_records": 1, "fan": 3, "radices": 1}]
)
def test_equals_brute_force_whatever_the_sizes_of_runs(spark, documents_of, libraries, sizes):
    found = ta.align_documents(documents_of(TEXTS), **sizes)
    expected, pairs = _brute(TEXTS, libraries)
    _same(found.documents.collect(), expected)
    assert {tuple(r) for r in found.pairs.collect()} == pairs


def test_query_equals_brute_force(spark, sample_documents, libraries):
    _same(QUERIES["op11_token_alignment"](spark, FOLDER).collect(), _brute(sample_documents, libraries)[0])


def test_tables_without_tokens(spark, documents_of):
    none = ta.align_documents(documents_of([]))
    assert none.documents.count() == none.pairs.count() == 0
    blank = ta.align_documents(documents_of([(1, None), (2, "")]))
    assert sorted(map(tuple, blank.documents.collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_extra_columns_with_own_names(spark):
    frame = spark.createDataFrame([(1, "the cat", "r", 5)], "doc_id long, text string, run string, radix int")
    assert ta.align_documents(frame).documents.first()["n_a"] == 2


def test_merging_sums_what_sorted_runs_hold():
    rng = random.Random(3)
    whole, runs = Counter(), []
    for _ in range(9):
        own = Counter(rng.randrange(200) << ta.ID_BITS | rng.randrange(5) for _ in range(rng.randrange(400)))
        keys = np.array(sorted(own), np.uint64)
        runs.append((ta._pack_keys(keys), ta._packed(np.array([own[int(k)] for k in keys]), "<u8")))
        whole.update(own)
    for block in (1, 7, 1 << 14):
        parts = list(ta.merge_runs(runs, block))
        keys = np.concatenate([k for k, _ in parts])
        assert keys.tolist() == sorted(whole)
        assert np.concatenate([t for _, t in parts]).tolist() == [whole[k] for k in sorted(whole)]


def test_long_texts_of_one_letter(spark):
    found = ta.align(ta.tokenizers(), "a" * 100_000)
    assert sum(ta.tokenizers().a_lengths[found.a]) == 100_001
