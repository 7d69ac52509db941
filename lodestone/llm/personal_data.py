"""Personal data: weak labelers vote, their reliabilities are estimated, a classifier decides.

Four kinds of spans are exact patterns (``BASE_KINDS``). Beyond them, candidates are
tokens that hold digits, numbers in groups, values of assignments and behind private
words, and names and addresses that word lists know. Patterns, word lists and context each vote on a
candidate: private, not private, or nothing. Candidates are counted by their
votes and features in one pass over all texts; from these counts, of which there
are a bounded number of kinds, expectation-maximisation estimates how reliable
each labeler is and how likely each kind of candidate is private, and a logistic
span classifier is trained on these likelihoods. The second pass adds the spans
that the classifier accepts, of kind ``secret``; base spans always stay.

Null texts are empty. Without candidates nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.registry import query, table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KIND = "secret"
ACCEPT = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that has no match at its start has none later either.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# -- what the labelers know (fixed values)
PRIVATE_WORDS = frozenset(
    "token key secret password passwd pwd api auth credential login pin ssn iban account card "
    "phone tel telephone mobile fax mail email contact passport licence".split()
)
PUBLIC_WORDS = frozenset(
    "version license page chapter section figure table year copyright release step line "
    "number total item".split()
)
_LOOSE_PHONE = re.compile(r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}")
_TOKEN = re.compile(r"[^\s\"'<>,;|]+")
_HEX = re.compile(r"[0-9a-fA-F]{16,}")
_MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/=_-]{20,}")
_PLAIN_NUMBER = re.compile(r"[0-9]{1,6}|[0-9]+(?:\.[0-9]+){1,2}|v[0-9.]+")
_WORD = re.compile(r"[a-z]+")
_GROUPS = re.compile(
    r"(?<![\w.-])(?:[A-Z]{2}[0-9]{2}(?:[ -][0-9A-Z]{4}){2,7}(?:[ -][0-9A-Z]{1,3})?|[0-9]{2,6}(?:[ -][0-9]{2,6})+)(?![\w-])"
)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}")
_SOCIAL = re.compile(r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}")
_VALUE = re.compile(
    r"(?:(?<![A-Za-z])(?i:" + "|".join(sorted(PRIVATE_WORDS)) + r")(?![A-Za-z])[\"']?(?:[ \t]*[:=]|[ \t]+(?i:is|number|no))?|\w[\"']?[ \t]*[:=])"
    r"[ \t]*[\"']?(?!//)(?P<value>[^\s\"'<>,;|:=]{3,})"
)
GIVEN_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul "
    "Steven Andrew George Peter Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Nancy Lisa Margaret Emily Emma Olivia Sophia Anna Maria Laura Julia Hans Klaus Wolfgang Stefan "
    "Andreas Jürgen Heike Petra Sabine Ursula Monika Pierre Jean Jacques Michel François Marie Claire "
    "Sophie Camille Carlos José Juan Luis Miguel Antonio Carmen Lucía Isabel Pablo"
).split()
_NAME = re.compile(
    r"(?<!\w)(?:" + "|".join(GIVEN_NAMES) + r")(?: [A-Z]\.)?(?: (?:von|van|de|del|la))?(?: [A-ZÄÖÜÉ][a-zäöüßéèáíóúñç]+(?:-[A-Z]\w+)?){1,2}(?!\w)"
)
_STREET = re.compile(
    r"(?<!\w)(?:[0-9]{1,5}[A-Za-z]? (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square)"
    r"|[0-9]{1,4},? (?:rue|avenue|boulevard|place) (?:(?:de|du|des|la) ){0,2}[A-ZÉ]\w+"
    r"|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|gasse|allee) [0-9]{1,4}[a-z]?"
    r"|(?:Calle|Avenida|Plaza) (?:(?:de|del|la) ){0,2}[A-Z]\w+,? [0-9]{1,4})(?!\w)"
)
_DIRECT = re.compile(
    r"(?<![a-z])(?:" + "|".join(sorted(PRIVATE_WORDS)) + r")[\"']?(?:[ \t]*[:=]|[ \t]+(?:is|number|no))[ \t]*[\"']?$"
)
_ORDINARY = re.compile(r"[^\W\d_]+[.!?]?")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Exact patterns, sorted by start and then kind, in code points."""
    found = [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


class Candidate(NamedTuple):
    start: int
    end: int
    token: str
    before: str  # what stands in front, lower case
    after: str


def _tokens(line: str) -> Iterator[tuple[int, int]]:
    """Tokens of at least six characters with a digit."""
    for m in _TOKEN.finditer(line):
        token = m[0].strip(".:!?*#$%&()=")
        if len(token) < 6 or not _DIGIT.search(token):
            continue
        start = m.start() + m[0].index(token)
        # An assignment is judged by its value.
        cut = max(token.rfind("="), token.rfind(":"))
        if 0 <= cut < len(token) - 6 and _DIGIT.search(token, cut):
            token, start = token[cut + 1 :], start + cut + 1
        yield start, start + len(token)


def _values(line: str) -> Iterator[tuple[int, int]]:
    """What stands behind a private word or an assignment."""
    at = 0
    while m := _VALUE.search(line, at):
        value = m["value"].rstrip(".!?*#$%&()")
        if len(value) >= 3:
            yield m.start("value"), m.start("value") + len(value)
        # The value may be a private word itself.
        at = max(m.start("value"), m.start() + 1)


def _apart(sources: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Spans that do not overlap; those of a source go before those of later ones."""
    kept: list[tuple[int, int]] = []
    for spans in sources:
        starts, ends = [s for s, _ in kept], [e for _, e in kept]
        added, last = [], -1
        for s, e in sorted(spans):
            i = bisect_right(ends, s)  # the first kept one that ends behind s
            if s >= last and (i == len(starts) or starts[i] >= e):
                added.append((s, e))
                last = e
        kept = sorted(kept + added)
    return kept


def candidates(text: str, base: list[Span]) -> Iterator[Candidate]:
    """Spans of all sources, by start; they overlap no base span and not each other."""
    starts, ends = [], []  # of stretches that base spans cover, in order
    for _, s, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    at = 0
    for line in text.splitlines(keepends=True):
        sources: list[list[tuple[int, int]]] = []
        if _DIGIT.search(line):
            sources.append([m.span() for m in _LOOSE_PHONE.finditer(line)])
            sources.append([m.span() for m in _GROUPS.finditer(line)])
            sources.append([m.span() for m in _STREET.finditer(line)])
            sources.append(list(_tokens(line)))
        sources.append([m.span() for m in _NAME.finditer(line)])
        sources.append(list(_values(line)))
        for s, e in _apart(sources):
            s, e = s + at, e + at
            covered = bisect_right(ends, s)  # the first stretch that ends behind s
            if covered < len(starts) and starts[covered] < e:
                continue
            yield Candidate(s, e, text[s:e], text[max(0, s - 48) : s].lower(), text[e : e + 2])
        at += len(line)


def _near(c: Candidate) -> list[str]:
    return _WORD.findall(c.before)[-3:]


def _assigned(c: Candidate) -> bool:
    return c.before.rstrip("\"' ").endswith(("=", ":"))


def _share(c: Candidate) -> float:
    return len(_DIGIT.findall(c.token)) / len(c.token)


def _account(c: Candidate) -> bool:
    """A social security number, or an account number whose check digits are right."""
    if _SOCIAL.fullmatch(c.token):
        return True
    plain = c.token.replace(" ", "").replace("-", "")
    return bool(_IBAN.fullmatch(plain)) and int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1


def _listed(c: Candidate) -> bool:
    return bool(_NAME.fullmatch(c.token) or _STREET.fullmatch(c.token))


def _direct(c: Candidate) -> bool:
    """A private word has this value."""
    return bool(_DIRECT.search(c.before))


def _ordinary(c: Candidate) -> bool:
    return bool(_ORDINARY.fullmatch(c.token)) and not _direct(c)


#: Each says 1 (private), 0 (not), or nothing (None).
LABELERS = {
    "pattern of a key": lambda c: 1 if _HEX.fullmatch(c.token) or _MIXED.fullmatch(c.token) else None,
    "pattern of a plain number": lambda c: 0 if _PLAIN_NUMBER.fullmatch(c.token) else None,
    "pattern of a phone number": lambda c: 1 if _LOOSE_PHONE.fullmatch(c.token) else None,
    "list of private words": lambda c: 1 if PRIVATE_WORDS.intersection(_near(c)) and not _ordinary(c) else None,
    "list of public words": lambda c: 0 if PUBLIC_WORDS.intersection(_near(c)) else None,
    "context of an assignment": lambda c: 1 if _assigned(c) and not _ordinary(c) else None,
    "context of an address": lambda c: 0 if "://" in c.token or "www." in c.token else None,
    "few digits in a word": lambda c: 0 if _share(c) < 0.2 and len(c.token) < 20 and not _listed(c) else None,
    "pattern of an account": lambda c: 1 if _account(c) else None,
    "list of names and streets": lambda c: 1 if _listed(c) else None,
    "context of a private value": lambda c: 1 if _direct(c) else None,
    "an ordinary word": lambda c: 0 if _ordinary(c) else None,
}

FEATURES = (
    lambda c: bool(_HEX.fullmatch(c.token)),
    lambda c: len(c.token) >= 12,
    lambda c: len(c.token) >= 20,
    lambda c: _share(c) >= 0.5,
    lambda c: _share(c) == 1.0,
    lambda c: c.token != c.token.lower(),
    lambda c: c.after[:1] in "\"'" and c.after != "",
    _assigned,
    lambda c: bool(PRIVATE_WORDS.intersection(_near(c))),
    lambda c: bool(PUBLIC_WORDS.intersection(_near(c))),
    lambda c: "." in c.token or "/" in c.token,
    lambda c: bool(_LOOSE_PHONE.fullmatch(c.token)),
    _account,
    _listed,
    _direct,
    _ordinary,
)


def votes_of(c: Candidate) -> int:
    """Votes in base three, the first labeler lowest: 0 not, 1 private, 2 nothing."""
    code = 0
    for label in reversed(LABELERS.values()):
        vote = label(c)
        code = code * 3 + (2 if vote is None else vote)
    return code


def features_of(c: Candidate) -> int:
    return sum(1 << i for i, f in enumerate(FEATURES) if f(c))


def _digits(codes: np.ndarray, base: int, n: int) -> np.ndarray:
    return np.stack([codes // base**i % base for i in range(n)], axis=1)


class Reliability(NamedTuple):
    """How often each labeler that votes is right, and the share of private candidates."""

    right: np.ndarray
    prior: float


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[Reliability, np.ndarray]:
    """Expectation-maximisation over kinds of votes; also each kind's likelihood.

    Ordinary words have a share of private ones of their own: they are no secrets
    for the reason that most other candidates are.
    """
    v = _digits(votes, 3, len(LABELERS))
    private, against = v == 1, v == 0
    ordinary = against[:, list(LABELERS).index("an ordinary word")]
    # Start from the majority, with labelers taken as a little better than chance.
    belief = (private.sum(1) + 0.5) / (private.sum(1) + against.sum(1) + 1.0)
    for _ in range(rounds):
        agree = private * belief[:, None] + against * (1 - belief)[:, None]
        cast = (private | against) * counts[:, None]
        right = ((agree * counts[:, None]).sum(0) + 4.0) / (cast.sum(0) + 5.0)
        right = np.clip(right, 0.55, 0.99)
        prior = float(np.clip((belief * counts).sum() / max(1, counts.sum()), 0.02, 0.98))
        shares = np.full(len(v), prior)
        for group in (ordinary, ~ordinary):
            share = (belief * counts)[group].sum() / max(1, counts[group].sum())
            shares[group] = np.clip(share, 0.02, 0.98)
        odds = np.log(shares / (1 - shares)) + (private.astype(float) - against) @ np.log(right / (1 - right))
        belief = 1 / (1 + np.exp(-odds))
    return Reliability(right, prior), belief


class Classifier(NamedTuple):
    weights: np.ndarray
    bias: float

    def likelihood(self, bits: int) -> float:
        at = self.bias + sum(w for i, w in enumerate(self.weights) if bits >> i & 1)
        return float(1 / (1 + np.exp(-np.clip(at, -500, 500))))


def train_classifier(bits: np.ndarray, belief: np.ndarray, counts: np.ndarray) -> Classifier:
    """Logistic regression of the likelihoods on the features, by Newton steps."""
    x = np.concatenate([_digits(bits, 2, len(FEATURES)), np.ones((len(bits), 1), np.int64)], axis=1)
    x = x.astype(float)
    # Rare kinds count too, however many others there are.
    share = np.maximum(counts / counts.sum() * min(counts.sum(), 1000.0), 3.0)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (share * (p - belief)) + 0.1 * w)
    return Classifier(w[:-1], float(w[-1]))


def learn(docs: DataFrame) -> Classifier | None:
    """A classifier from all candidates of all texts; none without candidates.

    Tasks send counts of kinds of candidates (votes and features), at most
    3^12 * 2^16 kinds for any number of texts and a few hundred in practice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds: Counter = Counter()
        for rows in batches:
            for text in rows["text"].tolist():
                if text:
                    kinds.update((votes_of(c), features_of(c)) for c in candidates(text, base_spans(text)))
        made = [(v, b, n) for (v, b), n in kinds.items()]
        yield pd.DataFrame(made, columns=["votes", "bits", "n"], dtype="int64")

    counted = docs.select("text").mapInPandas(run, "votes long, bits long, n long")
    rows = counted.groupBy("votes", "bits").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["votes"], r["bits"]))
    votes, bits, n = (np.array([r[c] for r in rows], np.int64) for c in ("votes", "bits", "n"))
    _, belief = estimate(votes, n)
    return train_classifier(bits, belief, n)


def added_spans(text: str, base: list[Span], classifier: Classifier | None) -> list[Span]:
    if classifier is None:
        return []
    return [
        (ADDED_KIND, c.start, c.end)
        for c in candidates(text, base)
        if classifier.likelihood(features_of(c)) >= ACCEPT
    ]


def joined(spans: list[Span]) -> str:
    kinds = (*BASE_KINDS, ADDED_KIND)
    ordered = sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span as its kind in brackets; overlapping ones become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """``doc_id, spans, masked``: all spans of every text, and the text without them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows["text"].tolist():
                base = base_spans(text or "")
                spans = base + added_spans(text or "", base, classifier)
                listed = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
                out.append((listed, None if text is None else masked(text, spans)))
            made = pd.DataFrame(out, columns=["spans", "masked"])
            made.insert(0, "doc_id", rows["doc_id"].astype("Int64"))
            yield made

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>, masked string"
    )


def masking(classifier: Classifier | None):
    """A column function from texts to texts with all spans masked (null: null)."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts.tolist():
            if text:
                base = base_spans(text)
                text = masked(text, base + added_spans(text, base, classifier))
            out.append(text)
        return pd.Series(out, dtype="object")

    return mask


def span_digests(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """Counts and digests of the spans of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows["text"].tolist():
                base = base_spans(text or "")
                count = Counter(k for k, _, _ in base)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                spans = base + added_spans(text or "", base, classifier)
                out.append((*(count[k] for k in BASE_KINDS), digest, joined(spans)))
            columns = [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
            made = pd.DataFrame(out, columns=columns)
            made.insert(0, "doc_id", rows["doc_id"].astype("Int64"))
            yield made

    return docs.select("doc_id", "text").mapInPandas(
        run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string",
    )


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's personal data."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return span_digests(docs, learn(docs))
