"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Every paragraph (line) is hashed to a wide vector of 64-bit numbers, and a
document's fingerprint is the sum of its paragraphs' vectors, each lane modulo
2^64. The order of paragraphs does not count, and adding or removing one is an
addition or subtraction. A vector has three parts:

* ``EXACT_LANES`` lanes straight from a hash of the paragraph's bytes. They agree for
  different multisets only if hashes, times differences of counts, add up to nothing in
  every lane: copies of one line by the ten thousands do not, as 2^64 copies would.
* One lane that counts paragraphs.
* ``SKETCH_LANES`` lanes in which each word triple of the paragraph adds +1 or
  -1 to one lane (a count sketch). The squared length of a difference estimates
  how many triples differ, which gives a likeness; fewer words than three count
  as one triple. Its standard error is about ``sqrt(2 / SKETCH_LANES)``. It is printed in
  32 bits, which a lane's sum leaves only beyond two billion equal triples.

All parts are sums over paragraphs, so inserting and deleting work on the
whole fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.registry import query, table

EXACT_LANES = 16
SKETCH_LANES = 128
LANES = EXACT_LANES + 1 + SKETCH_LANES
_SKETCH = slice(EXACT_LANES + 1, LANES)

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Paragraph vectors, with a bounded memory of word hashes."""

    def __init__(self, memory: int = 200_000):
        self._memory = memory
        self._words: dict[str, int] = {}

    def _word(self, word: str) -> int:
        if len(self._words) >= self._memory:
            self._words.clear()
        digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        value = self._words[word] = int.from_bytes(digest, "little")
        return value

    def _triples(self, paragraph: str) -> np.ndarray:
        words = paragraph.split()
        known = self._words.get
        found = [known(w) for w in words]
        if None in found:
            found = [self._word(w) if v is None else v for w, v in zip(words, found, strict=True)]
        h = np.array(found, np.uint64)
        if len(h) > 3:
            return _mixed(_mixed(_mixed(h[:-2]) + h[1:-1]) + h[2:])
        for k in range(1, len(h)):
            h[:1] = _mixed(h[:1]) + h[k : k + 1]
        return _mixed(h[:1])

    def vector(self, paragraphs: list[str]) -> np.ndarray:
        """The sum of the vectors of ``paragraphs``, as 64-bit numbers."""
        out = np.zeros(LANES, np.uint64)
        if not paragraphs:
            return out
        digests = b"".join(
            hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(8 * EXACT_LANES)
            for p in paragraphs
        )
        lanes = np.frombuffer(digests, "<u8").reshape(-1, EXACT_LANES)
        out[:EXACT_LANES] = lanes.sum(axis=0, dtype=np.uint64)
        out[EXACT_LANES] = len(paragraphs)
        triples = np.concatenate([self._triples(p) for p in paragraphs])
        lane = (triples % np.uint64(SKETCH_LANES)).astype(np.int64)
        sign = np.where(triples >> np.uint64(63), 1.0, -1.0)
        out[_SKETCH] = np.bincount(lane, sign, SKETCH_LANES).astype(np.int64).view(np.uint64)
        return out

    def fingerprint(self, text: str | None) -> np.ndarray:
        return self.vector(paragraphs_of(text))


def paragraphs_of(text: str | None) -> list[str]:
    """Lines that hold more than white space; null has none."""
    return [p for p in (text or "").split("\n") if p and not p.isspace()]


def inserted(fingerprint: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return fingerprint + vector


def deleted(fingerprint: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return fingerprint - vector


def as_text(fingerprint: np.ndarray) -> str:
    exact, sketch = fingerprint[: EXACT_LANES + 1], fingerprint[_SKETCH]
    return (exact.astype("<u8").tobytes() + sketch.astype("<u4").tobytes()).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal multisets of triples, about 0 for disjoint ones."""
    if np.array_equal(a, b):
        return 1.0
    x, y, d = (v[_SKETCH].view(np.int64).astype(np.float64) for v in (a, b, a - b))
    total = float(x @ x + y @ y)
    return min(1.0, max(0.0, 1.0 - float(d @ d) / total)) if total else 0.0


def edited_text(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the following text's start."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def edited_fingerprint(
    hasher: Hasher, text: str, following: str, own: np.ndarray
) -> tuple[str, np.ndarray]:
    """Edited text and its fingerprint, from the own one by deleting and inserting."""
    edited = edited_text(text, following)
    start = text.rfind("\n", 0, len(text) - len(text) // 3) + 1  # the paragraph of the cut
    gone = hasher.vector(paragraphs_of(text[start:]))
    new = hasher.vector(paragraphs_of(edited[start:]))
    return edited, inserted(deleted(own, gone), new)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the fingerprint of every text as lower-case hex (null: empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for rows in batches:
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"].astype("Int64"),
                    "fingerprint": [as_text(hasher.fingerprint(t)) for t in rows["text"]],
                }
            )

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fingerprint string")


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
#: Rows of one range of ids, and the most ranges that are made of any table.
RANGE_ROWS = 500
MAX_RANGES = 200_000
NO_ID = -1


def _places(docs: DataFrame, range_rows: int):
    """A function from ids to the ranges where their rows are needed.

    Only ids are read. The driver gets two numbers for each range, at most
    ``MAX_RANGES``, as a range partitioning needs them too.
    """
    ids = docs.where("doc_id is not null").select("doc_id")
    count = ids.count()
    parts = min(MAX_RANGES, max(1, -(-count // range_rows)))
    bounds = np.zeros(0, np.int64)
    if parts > 1:
        lows = ids.select(
            F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)
        ).first()[0]
        bounds = np.unique(np.array(lows, np.int64))

    @F.pandas_udf("long")
    def home(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna()
        out = np.full(len(doc_id), NO_ID, np.int64)
        out[known] = np.searchsorted(bounds, doc_id[known].astype("int64"), "right")
        return pd.Series(out)

    tops = ids.groupBy(home("doc_id").alias("home")).agg(F.max("doc_id").alias("top")).collect()
    tops = dict(sorted((r["home"], r["top"]) for r in tops))
    nulls = docs.where("doc_id is null").limit(1).count()
    order = [NO_ID] * nulls + list(tops)
    above = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    guests = {top: above[r] for r, top in tops.items()}

    @F.pandas_udf("array<struct<place:long,guest:boolean>>")
    def places(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna().to_numpy()
        ids = np.where(known, doc_id.fillna(0), 0).astype(np.int64)
        homes = np.where(known, np.searchsorted(bounds, ids, "right"), NO_ID)
        out = []
        for is_known, i, h in zip(known.tolist(), ids.tolist(), homes.tolist(), strict=True):
            own = [{"place": h, "guest": False}]
            other = guests.get(i) if is_known else above.get(NO_ID)
            out.append(own if other is None else [*own, {"place": other, "guest": True}])
        return pd.Series(out)

    return places


def compare_with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each row of ``docs`` fingerprinted, edited, and compared with the next.

    The next row is the one below in descending ``doc_id`` (after the last: the
    first, which may be itself). Null ids come last; rows of one id are ordered
    by their text. Null texts are empty. Texts are shuffled once: rows go to
    ranges of ids, and the top row of each range goes to the range above too,
    where it closes the order. Other columns are left out.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.select(
        F.inline(_places(rows, range_rows)("doc_id")), "doc_id", "text"
    ).repartition("place")
    placed = placed.sortWithinPartitions(
        "place", "guest", F.col("doc_id").desc_nulls_last(), "text"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        last = None  # place, id, text and fingerprint of the row that waits for its next
        for batch in batches:
            out = []
            columns = (batch[c].tolist() for c in ("place", "guest", "text"))
            ids = batch["doc_id"].astype("Int64").tolist()
            for place, guest, text, doc_id in zip(*columns, ids, strict=True):
                if guest and (last is None or last[0] != place):
                    continue
                own = hasher.fingerprint(text)
                if last is not None and last[0] == place:
                    out.append(_compared(hasher, *last[1:], text, own))
                last = None if guest else (place, doc_id, text, own)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return placed.mapInPandas(run, OUT)


def _compared(hasher, doc_id, text, own, following, next_own) -> tuple:
    edited, mark = edited_fingerprint(hasher, text, following, own)
    return (
        None if doc_id is pd.NA else doc_id,
        len(text),
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        as_text(own),
        as_text(mark),
        likeness(own, mark),
        likeness(own, next_own),
    )


@query("op5_multiset_fingerprint")
def op5_multiset_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, its edited text and the next document, by fingerprint."""
    return compare_with_next(table(spark, folder, "documents"))
