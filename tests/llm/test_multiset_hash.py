import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import multiset_hash as mh
from lodestone.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
LINES = st.lists(st.sampled_from(["a b c d", "x", "", "  ", "é ü", "a b c d e f"]), max_size=8)


@settings(deadline=None)
@given(LINES, st.randoms())
def test_order_does_not_count_and_edits_add_up(lines, random):
    hasher, other = mh.Hasher(), mh.Hasher(memory=1)
    shuffled = lines[:]
    random.shuffle(shuffled)
    whole = hasher.fingerprint("\n".join(lines))
    assert np.array_equal(whole, other.fingerprint("\n".join(shuffled)))
    grown = mh.inserted(whole, hasher.vector(["new line"]))
    assert np.array_equal(grown, hasher.fingerprint("\n".join([*lines, "new line"])))
    assert np.array_equal(mh.deleted(grown, hasher.vector(["new line"])), whole)


def test_different_multisets_differ():
    texts = ["a", "b", "a\na", "a\nb", "a b", "b a", "", "a\na\na", "a\nb\nb"]
    found = {mh.as_text(mh.Hasher().fingerprint(t)) for t in texts}
    assert len(found) == len(texts)


def test_likeness():
    hasher = mh.Hasher()
    lines = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(60)]
    a, half = hasher.vector(lines), hasher.vector(lines[:30] + ["other " * 3 + str(i) for i in range(30)])
    assert mh.likeness(a, a) == 1.0
    assert 0.25 < mh.likeness(a, half) < 0.9
    assert mh.likeness(a, hasher.vector([x.replace("w", "v") for x in lines])) < 0.4
    assert mh.likeness(hasher.vector([]), hasher.vector([])) == 1.0
    assert mh.likeness(a, hasher.vector([])) == 0.0


def _brute(rows):
    """(id, text, edited text, text of the next) by descending id."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        out.append((doc_id, text, text[: len(text) - cut] + following[:cut], following))
    return out


def _check(got, rows):
    got = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    hasher = mh.Hasher()
    for doc_id, text, edited, following in _brute(rows):
        r, own = got[doc_id], hasher.fingerprint(text)
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == mh.as_text(own)
        assert r["edited_fingerprint"] == mh.as_text(hasher.fingerprint(edited))
        assert r["near_edited"] == mh.likeness(own, hasher.fingerprint(edited))
        assert r["near_next"] == mh.likeness(own, hasher.fingerprint(following))


def test_query(spark, sample_documents):
    _check(QUERIES["op5_multiset_fingerprint"](spark, FOLDER).collect(), sample_documents)


def test_small_ranges(spark, documents_of, sample_documents):
    rows = [(i * 3 - 100, t) for i, t in sample_documents[:60]] + [(5000, None), (6000, "")]
    for size in (1, 7, 1000):
        _check(mh.compare_with_next(documents_of(rows).repartition(3), size).collect(), rows)


def test_one_and_no_document(spark, documents_of):
    one = mh.compare_with_next(documents_of(["abc\ndef"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert mh.compare_with_next(documents_of(["x"]).limit(0)).count() == 0


def test_null_and_repeated_ids(spark, documents_of):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "n"), (None, "m"), (2, "c"), (0, "z")]
    for size in (1, 100):
        got = mh.compare_with_next(documents_of(rows).repartition(2), size).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted(
            (i is None, i or 0, 1) for i, _ in rows
        )


def test_fingerprints(spark, documents_of):
    rows = mh.fingerprints(documents_of([None, "a\nb", "b\na"]).withColumnRenamed("lang", "fingerprint")).collect()
    found = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert found[1] == found[2] != found[0]


def test_many_copies_of_a_line_do_not_vanish():
    hasher = mh.Hasher()
    none = mh.as_text(hasher.fingerprint(""))
    texts = ["a line\n" * n for n in (1, 65_536, 65_537, 131_072)]
    seen = {mh.as_text(hasher.fingerprint(t)) for t in texts}
    assert len(seen) == 4 and none not in seen
    long = hasher.fingerprint("one two three\n" * 70_000)
    assert mh.likeness(long, hasher.fingerprint("one two three\n" * 35_000)) < 0.9
    assert mh.likeness(long, hasher.fingerprint("one two three\n" * 69_000)) > 0.9
