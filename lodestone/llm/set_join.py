"""Word-shingle similarity join by a partitioned universe and the pigeonhole principle.

A document is the set of its distinct word shingles; two link when their Jaccard
similarity is at least 80 / 100. Documents of one set are one class, and only the
class's smallest id is compared with others.

**Signatures.** Linked sets of sizes x <= y differ in at most ``(x + y) / 9``
elements. For each band of sizes ``[B, 2B)`` the universe of shingles is dealt by
hash to ``m`` segments, which cut a set into segment subsets. A set hands on the
signatures of ``U + 1`` non-empty subsets, where U bounds its differences to any
partner. All sets choose them by one order of subsets, those with the rarest
elements first, so of two linked sets some subset is handed on by both, and
passages that many documents share come last. (The order uses counts of
shingles in a table of fixed size; which order it is does not touch the result.)
A subset may count double: it then hands on its one-deletion neighbourhood too,
and is missed only if two elements of it differ. The segments of a band, and
whether they count double, are allocated by estimated cost. A set with too few
non-empty subsets hands on the next of ``SEEDS`` hashings as well, and under the
last one empty subsets too. A set that may have partners in the band below its
own takes part there too.

**Groups.** Sets with an equal signature are candidates, but a group never makes
all its pairs. First every member is compared with the smallest of its group (the
smallest of each Arrow batch before that, so a crowded signature sends one row of
a batch through the shuffle). Then only members that no verified link
connects so far are compared with each other.

**Verification.** Each set has a sketch of ``PARITY`` bits, the parities of its
elements' counts by hash. Two sets differ in at least as many elements as their
sketches differ in bits, so most chance candidates fall by size or sketch inside
the joins; what is left is verified on the shingle sets of both texts. Links are united by
rounds of stars over tables in the shared folder.

Null texts and texts without words are empty and linked with nothing. Rows
without an id have no component. Repeated rows have the component of their text;
rows of one id and different texts are one node of the search.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.registry import query, table
from lodestone.session import materialize

SHINGLE = 5
SEEDS = 6
#: A link needs SHARE[0] / SHARE[1] of the union.
SHARE = (4, 5)
COUNT_BINS = 1 << 20
#: 64-bit words of the sketch of parities.
PARITY = 16
#: What comparing two sets costs, in signatures.
COMPARISON = 50

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_C3 = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S30)) * _C1
    x = (x ^ (x >> _S27)) * _C2
    return x ^ (x >> _S31)


def words_of(text: str | None) -> list[bytes]:
    """Words between white space of ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Numbers(dict):
    """Words numbered as they come, with their hashes."""

    def __init__(self) -> None:
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        digest = hashlib.blake2b(word, digest_size=8).digest()
        self.hashes.append(int.from_bytes(digest, "little"))
        self[word] = len(self.hashes) - 1
        return self[word]


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes."""

    def __init__(self, size: int = SHINGLE, memory: int = 300_000):
        self._size, self._limit = size, memory
        self._forget()

    def _forget(self) -> None:
        self._numbers, self._hashes, self._filled = _Numbers(), np.zeros(1024, np.uint64), 0

    def set_of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        if self._filled > self._limit:
            self._forget()
        at = np.array([*map(self._numbers.__getitem__, words)], np.int64)
        known = len(self._numbers.hashes)
        if known > len(self._hashes):
            self._hashes = np.concatenate([self._hashes, np.zeros(known, np.uint64)])
        if known > self._filled:
            self._hashes[self._filled : known] = self._numbers.hashes[self._filled :]
            self._filled = known
        h = self._hashes[at]
        n = min(self._size, len(h))
        rolled = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            rolled = rolled * _C2 + h[k : len(h) - n + 1 + k]
        return np.unique(mix(rolled))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both)


def set_key(elements: np.ndarray) -> str | None:
    if not len(elements):
        return None
    return hashlib.blake2b(elements.tobytes(), digest_size=16).hexdigest()


def parities(elements: np.ndarray) -> np.ndarray:
    """Bit by bit whether an even or odd number of elements fell there, as words."""
    bits = np.bincount((elements >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY)
    return np.packbits(bits.astype(np.uint8) & 1).view(np.int64)


# -- signatures


class Band(NamedTuple):
    """Sizes ``[low, 2 * low)`` and how their sets are cut."""

    low: int
    segments: int
    double: bool


def differences(size: int, largest_partner: int) -> int:
    """Most differences between a set and a linked one of at most the given size."""
    partner = min(largest_partner, size * SHARE[1] // SHARE[0])
    return (SHARE[1] - SHARE[0]) * (size + partner) // (SHARE[1] + SHARE[0])


def allocate(low: int, crowded: float) -> Band:
    """The cheapest cut of a band's sets.

    ``crowded`` is the share of shingles that many documents have. A subset of t
    elements is a chance candidate about ``crowded ** t`` of the time; a set with
    too few subsets that count is cut again under every further hashing.
    """
    size = 2 * low - 1
    need = differences(size, 2 * size) + 1
    choices = []
    for slack in (1.0, 1.03, 1.06, 1.1, 1.2, 1.4, 2.0):
        m = math.ceil(need * slack) + 1
        each = size / m
        filled = m * (1 - math.exp(-each))
        spread = math.sqrt(max(1e-9, m * math.exp(-each) * (1 - (1 + each) * math.exp(-each))))
        fails = 0.5 * math.erfc((filled - need + 0.5) / spread / math.sqrt(2))
        cost = need * (1 + COMPARISON * crowded ** max(1.0, each)) * (1 + SEEDS * fails)
        choices.append((cost, Band(low, m, False)))
    if need == 2:
        each = size - 1
        choices.append((size + 1 + COMPARISON * crowded**each, Band(low, 1, True)))
    return min(choices)[1]


class Signer:
    """Signatures of sets under given bands and counts of shingles."""

    def __init__(self, counts: np.ndarray, crowded: float):
        self._counts, self._crowded = counts, crowded
        self._bands: dict[int, Band] = {}

    def _band(self, low: int) -> Band:
        if low not in self._bands:
            self._bands[low] = allocate(low, self._crowded)
        return self._bands[low]

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        n = len(elements)
        if differences(n, 2 * n) == 0:
            return np.zeros(0, np.uint64)  # only the same set links with it
        low = 1 << (n.bit_length() - 1)
        out = self._cut(elements, self._band(low), differences(n, 2 * n))
        if low > 1 and n * SHARE[0] < low * SHARE[1]:
            out += self._cut(elements, self._band(low // 2), differences(n, low - 1))
        return np.unique(np.concatenate(out))

    def _cut(self, elements: np.ndarray, band: Band, bound: int) -> list[np.ndarray]:
        m, out = band.segments, []
        value = mix(elements + _C3)
        rarity = self._counts[(elements & np.uint64(COUNT_BINS - 1)).astype(np.int64)]
        for seed in range(SEEDS):
            salt = mix(np.array([(band.low << 8) + seed], np.uint64))
            segment = (mix(elements ^ salt) % np.uint64(m)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, segment, value)
            rarest = np.full(m, np.iinfo(np.int64).max)
            np.minimum.at(rarest, segment, rarity)
            sizes = np.bincount(segment, minlength=m)
            name = mix((np.arange(m, dtype=np.uint64) + _C3) * _C1 + salt)
            whole = mix(sums ^ name)
            filled = np.flatnonzero(sizes)
            order = filled[np.lexsort((whole[filled], rarest[filled]))]
            weight = np.where(sizes[order] > 1, 1 + band.double, 1)
            reached = np.cumsum(weight)
            take = int(np.searchsorted(reached, bound + 1)) + 1
            chosen = order[:take]
            out.append(whole[chosen])
            if band.double:
                inside = np.isin(segment, chosen[sizes[chosen] > 1])
                at = segment[inside]
                out.append(mix((sums[at] - value[inside]) ^ name[at]))
            if len(order) and reached[-1] > bound:
                return out
            if seed == SEEDS - 1:
                out.append(whole[sizes == 0])
        return out


# -- Spark


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key``, sketch of every row, and parts of the count table.

    Rows with a ``part`` hold a slice of a task's counts of shingles (``counts``,
    compressed 32-bit numbers) instead of a document.
    """
    slices = 16
    sketch = [f"p{i}" for i in range(PARITY)]
    empty = {c: pd.array([None] * slices, "Int64") for c in sketch}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, counts = Shingler(), np.zeros(COUNT_BINS, np.uint32)
        for rows in batches:
            found, sketches, seen, pending = [], [], [], 0
            for text in rows["text"].tolist():
                elements = shingler.set_of(text)
                found.append((len(elements), set_key(elements)))
                sketches.append(parities(elements))
                seen.append((elements & np.uint64(COUNT_BINS - 1)).astype(np.int64))
                pending += len(elements)
                if pending > COUNT_BINS:
                    np.add.at(counts, np.concatenate(seen), np.uint32(1))
                    seen, pending = [], 0
            if seen:
                np.add.at(counts, np.concatenate(seen), np.uint32(1))
            made = pd.DataFrame(found, columns=["n_shingles", "set_key"])
            made.insert(0, "doc_id", rows["doc_id"].astype("Int64"))
            words = np.array(sketches, np.int64).reshape(-1, PARITY)
            made[sketch] = words
            yield made.assign(part=pd.array([None] * len(made), "Int32"), counts=None)
        if counts.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, slices)]
            yield pd.DataFrame(
                {
                    "doc_id": pd.array([None] * slices, "Int64"),
                    "n_shingles": pd.array([None] * slices, "Int64"),
                    "set_key": None,
                    **empty,
                    "part": np.arange(slices, dtype=np.int32),
                    "counts": parts,
                }
            )

    return docs.select("doc_id", "text").mapInPandas(
        run,
        "doc_id long, n_shingles long, set_key string, "
        + "".join(f"{c} long, " for c in sketch)
        + "part int, counts binary",
    )


def count_table(sets: DataFrame) -> np.ndarray:
    """Counts of shingles by bin, of fixed size, summed over all tasks."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(
            np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64) for c in group["counts"]
        )
        data = zlib.compress(total.tobytes(), 1)
        return pd.DataFrame({"part": group["part"].iloc[:1], "counts": [data]})

    summed = sets.where("part is not null").select("part", "counts").groupBy("part")
    rows = summed.applyInPandas(add, "part int, counts binary").collect()
    if not rows:
        return np.zeros(COUNT_BINS, np.int64)
    rows = sorted(rows, key=lambda r: r["part"])
    return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in rows])


def crowded_share(counts: np.ndarray) -> float:
    """Share of occurrences in bins that stand out from the mean."""
    total = counts.sum()
    usual = total / len(counts)
    return float(counts[counts > usual + 4 * math.sqrt(usual) + 1].sum() / total) if total else 0.0


def group_members(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``signature, node``: every document that shares a signature with another.

    Copies within an Arrow batch hand on one set of signatures, that of the
    smallest id.
    """
    signer_args = counts, crowded_share(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(), Signer(*signer_args)
        for rows in batches:
            sets: dict[str, tuple] = {}
            for doc_id, text in zip(
                rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True
            ):
                if doc_id is None:
                    continue
                elements = shingler.set_of(text)
                key = set_key(elements)
                if key is not None and (key not in sets or doc_id < sets[key][0]):
                    sets[key] = doc_id, elements
            found = [(i, signer.signatures(e)) for i, e in sets.values()]
            if not found:
                continue
            signature = np.concatenate([s for _, s in found]).view(np.int64)
            node = np.repeat([i for i, _ in found], [len(s) for _, s in found])
            order = np.lexsort((node, signature))
            signature, node = signature[order], node[order]
            first = np.r_[True, signature[1:] != signature[:-1]][: len(signature)]
            alone = np.r_[first[1:], True][: len(signature)] & first
            # The smallest of a group goes to the signature's task, its group to any.
            place = np.where(first, signature, mix((signature ^ node).view(np.uint64)).view(np.int64))
            extra = first & ~alone
            columns = [
                np.concatenate([place, place[extra] ^ node[extra]]),
                np.concatenate([signature, signature[extra]]),
                np.concatenate([node, node[extra]]),
                np.concatenate([~first, np.ones(extra.sum(), bool)]),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], ["place", "signature", "node", "grouped"]
            )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for rows in batches:
            signature, node = (rows.column(c).to_numpy() for c in ("signature", "node"))
            grouped = rows.column("grouped").to_numpy(zero_copy_only=False)
            if grouped.any():
                yield _members(signature[grouped], node[grouped])
            parts.append((signature[~grouped], node[~grouped]))
        if parts:
            signature, node = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(signature, kind="stable")
            signature, node = signature[order], node[order]
            same = signature[1:] == signature[:-1]
            kept = np.r_[same, False] | np.r_[False, same]
            yield _members(signature[kept], node[kept])

    signed = docs.select("doc_id", "text").mapInArrow(
        sign, "place long, signature long, node long, grouped boolean"
    )
    return signed.repartition("place").mapInArrow(shared, "signature long, node long").distinct()


def _members(signature: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signature), pa.array(node)], ["signature", "node"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``a, b`` whose texts link; only texts of pairs are moved."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = materialize(ids, "pair-ids")
    texts = materialize(
        docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "pair-texts"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, last, elements = Shingler(), None, None
        for rows in batches:
            keep = []
            for a, one, other in zip(rows["a"], rows["text_a"], rows["text_b"], strict=True):
                if last != (a, one):
                    last, elements = (a, one), shingler.set_of(one)
                keep.append(linked(elements, shingler.set_of(other)))
            yield rows.loc[keep, ["a", "b"]]

    def of(name: str) -> DataFrame:
        return texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))

    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    return joined.mapInPandas(run, "a long, b long").distinct()


SKETCH = ("n_shingles", *(f"p{i}" for i in range(PARITY)))


def node_sketches(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``node`` with size and sketch of its set; none for ids with several sets."""
    first = classes.select("set_key", F.col("first").alias("doc_id"))
    found = rows.join(first, ["set_key", "doc_id"]).groupBy(F.col("doc_id").alias("node"))
    kept = found.agg(
        F.min("set_key").alias("low"), F.max("set_key").alias("high"), *[F.min(c).alias(c) for c in SKETCH]
    )
    return kept.where("low = high").select("node", *SKETCH)


def may_link(one: str, other: str):
    """What size and sketch of two sets, with these prefixes, cannot rule out."""
    x, y = F.col(f"{one}n_shingles"), F.col(f"{other}n_shingles")
    apart = sum(
        F.bit_count(F.col(f"{one}p{i}").bitwiseXOR(F.col(f"{other}p{i}"))) for i in range(PARITY)
    )
    sizes = F.least(x, y) * SHARE[1] >= F.greatest(x, y) * SHARE[0]
    bound = (SHARE[1] + SHARE[0]) * apart <= (SHARE[1] - SHARE[0]) * (x + y)
    return F.coalesce(sizes & bound, F.lit(True))


def _named(sketches: DataFrame, node: str, prefix: str) -> DataFrame:
    return sketches.select(F.col("node").alias(node), *[F.col(c).alias(prefix + c) for c in SKETCH])


def star_pairs(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Each member with the smallest of its group, where they may link."""
    least = members.groupBy("signature").agg(F.min("node").alias("a"))
    joined = members.join(least, "signature").where("node <> a")
    pairs = joined.select("a", F.col("node").alias("b")).distinct()
    pairs = pairs.join(_named(sketches, "b", "b_"), "b", "left")
    pairs = pairs.join(_named(sketches, "a", "a_"), "a", "left")
    return pairs.where(may_link("a_", "b_")).select("a", "b")


def cross_pairs(
    members: DataFrame, labels: DataFrame, sketches: DataFrame, compared: DataFrame
) -> DataFrame:
    """Pairs of a group that may link, that no link connects and that were not compared."""
    named = members.join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    named = materialize(named, "labelled-members")
    split = (
        named.groupBy("signature")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high")
        .select("signature")
    )
    open_groups = named.join(split, "signature", "left_semi")
    open_groups = materialize(open_groups.join(_named(sketches, "node", "a_"), "node", "left"), "open-groups")
    other = open_groups.select(
        "signature",
        F.col("node").alias("other"),
        F.col("label").alias("other_label"),
        *[F.col("a_" + c).alias("b_" + c) for c in SKETCH],
    )
    pairs = open_groups.join(
        other, (open_groups.signature == other.signature) & (F.col("label") < F.col("other_label")) & may_link("a_", "b_")
    )
    pairs = pairs.select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
    )
    return pairs.distinct().join(compared, ["a", "b"], "left_anti")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that links lead to, for every linked node.

    Nodes are hung on their smallest neighbour, then everything on that one's
    neighbour, until nothing moves; every round is a table in the shared folder.
    """
    pairs = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    while True:
        # Every node and its neighbours go to the smallest of them.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        stars = both.join(least, "a").select("a", "b", "least")
        moved = (
            stars.select(F.col("least").alias("x"), F.col("b").alias("y"))
            .unionByName(stars.select(F.col("least").alias("x"), F.col("a").alias("y")))
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        moved = materialize(moved, "links")
        # Done when every node hangs on one node only, which hangs on none.
        hung = moved.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        chained = moved.join(moved.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        pairs = moved
        if not hung and not chained:
            return pairs.select(F.col("b").alias("node"), F.col("a").alias("label"))


def near_labels(links: DataFrame) -> DataFrame:
    """``node, label``: a smaller node that links lead to in at most two steps."""
    up = links.groupBy("b").agg(F.min("a").alias("up"))
    above = up.select(F.col("b").alias("up"), F.col("up").alias("top"))
    return up.join(above, "up", "left").select(
        F.col("b").alias("node"), F.coalesce("top", "up").alias("label")
    )


def join_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    sets = materialize(shingle_sets(docs), "shingle-sets")
    counts = count_table(sets)
    rows = sets.where("part is null")
    classes = rows.where("set_key is not null and doc_id is not null").groupBy("set_key")
    classes = materialize(
        classes.agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "set-classes"
    )
    members = materialize(
        group_members(docs, counts).join(
            classes.select(F.col("first").alias("node")), "node", "left_semi"
        ),
        "set-members",
    )
    sketches = node_sketches(rows, classes).join(members.select("node"), "node", "left_semi")
    sketches = materialize(sketches, "node-sketches")
    stars = materialize(star_pairs(members, sketches), "star-pairs")
    links = materialize(verified(stars, docs), "star-links")
    rest = cross_pairs(members, near_labels(links), sketches, stars)
    links = links.unionByName(verified(materialize(rest, "cross-pairs"), docs))
    roots = components(links)
    several = classes.where("n > 1").select("set_key", "first")
    placed = rows.select("doc_id", "n_shingles", "set_key").join(several, "set_key", "left").withColumn(
        "first", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.coalesce("first", "doc_id"))
    )
    return placed.join(roots.withColumnRenamed("node", "first"), "first", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "first")).alias("component_id"),
    )


@query("op7_shingle_join")
def op7_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the smallest id that links of 80 / 100 lead to."""
    return join_sets(table(spark, folder, "documents"))
