import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import personal_data as pd_
from lodestone.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    """The contract's patterns as they are written."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pd_.BASE_KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab1.@+-_ ()2%39\né", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pd_.base_spans(text) == brute(text)


def test_hard_texts():
    for text in ("1" * 30000, "1." * 20000, "a" * 30000 + "@", "@" * 20000, "+1" * 20000, "a@b.c" * 5000):
        assert isinstance(pd_.base_spans(text), list)
    assert pd_.base_spans("0000255.1.1.1 4111 1111 1111 1111 +1 (743) 555-3824") == brute(
        "0000255.1.1.1 4111 1111 1111 1111 +1 (743) 555-3824"
    )


def test_query(spark, sample_documents):
    got = {r["doc_id"]: r for r in QUERIES["op10_personal_data"](spark, FOLDER).collect()}
    assert len(got) == len(sample_documents)
    for doc_id, text in sample_documents:
        r, base = got[doc_id], brute(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pd_.BASE_KINDS] == [sum(b[0] == k for b in base) for k in pd_.BASE_KINDS]
        listed = r["spans"].split(",") if r["spans"] else []
        assert set(joined.split(",")) - {""} <= set(listed)
        assert [int(s.split(":")[1]) for s in listed] == sorted(int(s.split(":")[1]) for s in listed)


def test_reliabilities_and_votes():
    """Labelers that side with the majority come out reliable, a contrary one does not."""
    names = list(pd_.LABELERS)

    def code(**votes):
        return sum(votes.get(f"l{i}", 2) * 3**i for i in range(len(names)))

    votes = np.array([code(l0=1, l3=1, l5=1, l1=0), code(l0=1, l3=1), code(l7=0, l4=0), code(l7=0, l4=0, l1=1)])
    found, belief = pd_.estimate(votes, np.array([50, 50, 60, 40]))
    assert found.right[0] > 0.9 and found.right[7] > 0.9 and found.right[1] < 0.6
    assert belief[:2].min() > 0.9 and belief[2:].max() < 0.1


def test_secrets_are_added_and_plain_numbers_are_not(spark, documents_of):
    words = "these are plain words "
    texts = [f'{words}token = "{i:02d}bac4d15ec8f90433955bf9d3cf61da5b{i:02d}" end' for i in range(30)]
    texts += [f"{words}password={i}cb0ab732d29a210e{i} end" for i in range(30)]
    texts += [f"{words}chapter 12345{i}, figure 2.{i}.17 end" for i in range(60)]
    docs = documents_of([*texts, None, "", "write a.b@c.de or 10.0.0.1"]).withColumnRenamed("lang", "spans")
    classifier = pd_.learn(docs)
    rows = {r["doc_id"]: r for r in pd_.find_personal_data(docs, classifier).collect()}
    assert all([s["kind"] for s in rows[i]["spans"]] == ["secret"] for i in range(60))
    assert all(rows[i]["spans"] == [] for i in range(60, 120))
    assert rows[0]["masked"] == f'{words}token = "[SECRET]" end'
    assert rows[120]["masked"] is None and rows[121]["masked"] == ""
    assert rows[122]["masked"] == "write [EMAIL] or [IP]"
    assert pd_.learn(docs.limit(0)) is None and pd_.learn(documents_of(["no digits"])) is None
    assert pd_.span_digests(docs.limit(0), None).count() == 0


def test_overlapping_spans_are_masked_once():
    assert pd_.masked("abcdefgh", [("ip", 1, 4), ("card", 3, 6), ("phone", 7, 8)]) == "a[IP]g[PHONE]"


def test_spans_of_all_sources(spark, documents_of):
    private = {
        "password: hunterxyzabc here": "hunterxyzabc",
        "my pin: 4821 ok": "4821",
        "ssn 078 05 1120": "078 05 1120",
        "IBAN DE89 3704 0044 0532 0130 00 thanks": "DE89 3704 0044 0532 0130 00",
        "we met Anna Schmidt today": "Anna Schmidt",
        "she lives at 12 Baker Street now": "12 Baker Street",
    }
    plain = ["Note: this is fine", "the key idea is simple", "version 1234567 of the page"]
    many = [f'token = "{i:040x}"' for i in range(10**12, 10**12 + 300)]
    docs = documents_of([*private, *plain, *many])
    rows = pd_.find_personal_data(docs, pd_.learn(docs)).collect()
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in rows}
    for i, (text, span) in enumerate(private.items()):
        at = text.index(span)
        assert found[i] == [(at, at + len(span))], text
    assert found[6] == [] and found[7] == []
