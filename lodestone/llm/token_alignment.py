"""Alignment of two tokenizers over a corpus, with pairs counted by external spilling.

Both tokenizers cut the same bytes. Offsets where a token of each ends cut a text
into groups, and the two tokens that end there are a link. How often a pair of ids
is linked is known only at the end of the corpus, and each document wants these
counts of its own pairs, so pair-document records go out and contributions come back:

1. **Spill.** Tasks encode texts and collect records (pair, document, times). A full
   buffer is sorted side-major, by the id of B, then of A, cut by a radix of the id
   of B, and becomes a run: zstd blobs of keys, their totals, and their documents.
2. **Count.** Runs' keys and totals, already one entry per pair and run, are merged
   by a heap, ``FAN`` runs at a time, level by level, until each radix has one list.
   It is in the order of B, so the highest total of a B id is known when its pairs end.
3. **Contribute.** The lists meet the records of their radix again, run by run; a
   radix of many records is dealt to several tasks by its runs. Each sums what the
   pairs give to the documents of a run.
4. **Gather.** The sums of a run are added and put beside its documents' own figures.

No task holds more than ``FAN`` lists of a radix, one run, or ``SALT_BYTES`` of
records, however hot a pair is, and the driver sees one row per radix. Runs are a
written table, so lost executors change no number of a run.

Null and empty texts, and texts that the tokens of one side do not spell out, have
no tokens. Repeated rows and rows without an id are documents of their own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.registry import query, table
from lodestone.session import materialize

RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
RADICES = 64
RUN_RECORDS = 1 << 20
RUN_DOCS = 1 << 16
FAN = 16
SALT_BYTES = 64 << 20
#: Entries of a run that are read from its blob at a time while merging.
BLOCK = 1 << 14
ID_BITS, DOC_BITS = 24, 16

FIGURES = "n_a long, n_b long, n_groups long, n_links long"
SPILL = (
    "run long, radix int, keys binary, totals binary, sizes binary, docs binary, times binary, "
    f"doc int, doc_id long, {FIGURES}, groups_sha256 string"
)


# -- one text ---------------------------------------------------------------------------


class Pair(NamedTuple):
    """Two tokenizers and the bytes of their tokens."""

    a: object
    b: object
    a_bytes: np.ndarray
    b_bytes: np.ndarray
    a_lengths: np.ndarray
    b_lengths: np.ndarray
    printed: list[np.ndarray]  # ids in decimal, with what may follow them


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


@lru_cache(maxsize=1)
def tokenizers(ranks_path: str | None = None, pieces_path: str | None = None) -> Pair:
    """The byte-level side (A) from its ranks, the piece side (B) from its model."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    a = tiktoken.Encoding(
        "aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    b = sentencepiece.SentencePieceProcessor(
        model_file=str(pieces_path or public_tokenizers.path(PIECES))
    )
    a_bytes = np.full(max(ranks.values()) + 1, b"", dtype=object)
    for token, rank in ranks.items():
        a_bytes[rank] = token
    b_bytes = np.full(b.get_piece_size(), b"", dtype=object)
    for i in range(len(b_bytes)):
        b_bytes[i] = _piece_bytes(b.id_to_piece(i))
    most = max(len(a_bytes), len(b_bytes))
    if most > 1 << ID_BITS:
        raise ValueError(f"Vocabularies of over {1 << ID_BITS} ids are not packed.")
    printed = [np.array([f"{i}{end}" for i in range(most)], dtype=object) for end in (",", "|", ";", "")]
    lengths = [np.array([len(t) for t in side], np.int64) for side in (a_bytes, b_bytes)]
    return Pair(a, b, a_bytes, b_bytes, *lengths, printed)


class Aligned(NamedTuple):
    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray  # places in ``a`` of the last token of each group
    ends_b: np.ndarray


def align(pair: Pair, text: str | None) -> Aligned | None:
    """Ids of both sides and the ends of the groups; none where they do not spell the text."""
    if not text:
        return None
    spaced = " " + text
    source = spaced.encode()
    a = pair.a.encode_to_numpy(spaced, disallowed_special=()).astype(np.int64)
    b = np.array(pair.b.encode(text), np.int64)
    if not len(a) or not len(b):
        return None
    if b"".join(pair.a_bytes[a].tolist()) != source or b"".join(pair.b_bytes[b].tolist()) != source:
        return None
    at_a, at_b = np.cumsum(pair.a_lengths[a]), np.cumsum(pair.b_lengths[b])
    marks = np.zeros(len(source) + 1, np.uint8)
    marks[at_a] = 1
    marks[at_b] += 2
    return Aligned(a, b, np.flatnonzero(marks[at_a] == 3), np.flatnonzero(marks[at_b] == 3))


def printed_groups(pair: Pair, found: Aligned) -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3``."""
    side_a = 2 * np.searchsorted(found.ends_a, np.arange(len(found.a)))
    side_b = 2 * np.searchsorted(found.ends_b, np.arange(len(found.b))) + 1
    place = np.concatenate([side_a, side_b])
    order = np.argsort(place, kind="stable")
    place, ids = place[order], np.concatenate([found.a, found.b])[order]
    step = np.diff(place, append=place[-1])
    follows = np.where(step == 0, 0, np.where(place & 1, 2, 1))
    follows[-1] = 3
    out = np.empty(len(ids), dtype=object)
    for code, strings in enumerate(pair.printed):
        here = follows == code
        out[here] = strings[ids[here]]
    return "".join(out.tolist())


# -- runs -------------------------------------------------------------------------------


def _packed(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.astype(kind).tobytes())


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _opened(blob: bytes):
    return zstandard.ZstdDecompressor().stream_reader(blob)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=keys.dtype.type(0)), "<u8")


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob, "<u8"), dtype=np.uint64)


def _radix(keys: np.ndarray, radices: int) -> np.ndarray:
    b = keys >> np.uint64(ID_BITS)
    return ((b * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) * np.uint64(radices) >> np.uint64(32)).astype(np.int64)


def sorted_run(records: np.ndarray, radices: int) -> Iterator[tuple]:
    """``radix, keys, totals, sizes, docs, times`` of records ``key << DOC_BITS | document``.

    ``sizes`` are the numbers of documents of the keys, ``times`` how often a
    document holds the key.
    """
    found, times = np.unique(records, return_counts=True)
    keys = found >> np.uint64(DOC_BITS)
    radix = _radix(keys, radices)
    order = np.argsort(radix, kind="stable")
    edges = np.searchsorted(radix[order], np.arange(radices + 1))
    for r in range(radices):
        part = order[edges[r] : edges[r + 1]]
        if not len(part):
            continue
        own, n = keys[part], times[part]
        starts = np.flatnonzero(np.diff(own, prepend=~own[0]))
        sizes = np.diff(starts, append=len(own))
        docs = found[part] & np.uint64((1 << DOC_BITS) - 1)
        yield (
            r,
            _pack_keys(own[starts]),
            _packed(np.add.reduceat(n, starts), "<u8"),
            _packed(sizes, "<u4"),
            _packed(docs, "<u2"),
            _packed(n, "<u4"),
        )


def spill(
    docs: DataFrame,
    ranks_path: str | None = None,
    pieces_path: str | None = None,
    radices: int = RADICES,
    run_records: int = RUN_RECORDS,
) -> DataFrame:
    """Runs of records (``radix`` from 0) and rows of documents (``radix`` null)."""
    columns = [c.split()[0] for c in SPILL.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=columns)
        for name in ("run", "radix", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links"):
            made[name] = made[name].astype("Int64")
        return made.astype({"groups_sha256": object})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = tokenizers(ranks_path, pieces_path)
        number, buffer, held, doc, out = None, [], 0, 0, []

        def close() -> Iterator[dict]:
            if buffer:
                for r, keys, totals, sizes, owners, times in sorted_run(np.concatenate(buffer), radices):
                    yield {"run": number, "radix": r, "keys": keys, "totals": totals,
                           "sizes": sizes, "docs": owners, "times": times}

        for rows in batches:
            if number is None:
                number = int(rows["part"].iloc[0]) << 32
            names = rows["doc_id"].astype("Int64").tolist()
            for name, text in zip(names, rows["text"].tolist(), strict=True):
                found = align(pair, text)
                made = {"run": number, "doc": doc, "doc_id": name, "groups_sha256": ""}
                counts = (0, 0, 0, 0)
                if found is not None:
                    digest = hashlib.sha256(printed_groups(pair, found).encode())
                    made["groups_sha256"] = digest.hexdigest()
                    links = len(found.ends_a)
                    counts = (len(found.a), len(found.b), links, links)
                    a, b = found.a[found.ends_a], found.b[found.ends_b]
                    key = (b << (ID_BITS + DOC_BITS) | a << DOC_BITS | doc).astype(np.uint64)
                    buffer.append(key)
                    held += links
                made |= zip(("n_a", "n_b", "n_groups", "n_links"), counts, strict=True)
                out.append(made)
                doc += 1
                if held >= run_records or doc == RUN_DOCS:
                    out += close()
                    number, buffer, held, doc = number + 1, [], 0, 0
            if out:
                yield frame(out)
                out = []
        out = list(close())
        if out:
            yield frame(out)

    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    return rows.mapInPandas(run, SPILL)


# -- counting ---------------------------------------------------------------------------


class _Run:
    """Keys and totals of one run, a block at a time."""

    def __init__(self, keys: bytes, totals: bytes, block: int):
        self._keys, self._totals = _opened(keys), _opened(totals)
        self._block, self._last = block, np.uint64(0)
        self.more()

    def more(self) -> None:
        steps = np.frombuffer(self._keys.read(8 * self._block), "<u8")
        self.keys = np.cumsum(steps, dtype=np.uint64) + self._last
        self.totals = np.frombuffer(self._totals.read(8 * self._block), "<u8").astype(np.int64)
        if len(self.keys):
            self._last = self.keys[-1]

    def upto(self, key: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        n = np.searchsorted(self.keys, key, "right")
        taken = self.keys[:n], self.totals[:n]
        self.keys, self.totals = self.keys[n:], self.totals[n:]
        return taken


def merge_runs(runs: list[tuple[bytes, bytes]], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and their summed totals of sorted runs, in stretches.

    The heap is ordered by the last key in hand of each run. Up to the smallest of
    these every run's keys are in hand, so that stretch is summed and leaves.
    """
    open_runs = [_Run(keys, totals, block) for keys, totals in runs]
    heap = [(int(r.keys[-1]), i) for i, r in enumerate(open_runs) if len(r.keys)]
    heapq.heapify(heap)
    while heap:
        bound = np.uint64(heap[0][0])
        parts = [r.upto(bound) for r in open_runs if len(r.keys)]
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, place, np.concatenate([t for _, t in parts]))
        yield keys, sums
        while heap and heap[0][0] == int(bound):
            _, i = heapq.heappop(heap)
            if not len(open_runs[i].keys):
                open_runs[i].more()
            if len(open_runs[i].keys):
                heapq.heappush(heap, (int(open_runs[i].keys[-1]), i))


def highest(keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Whether a pair has the highest total of its B id; keys are side-major."""
    if not len(keys):
        return np.zeros(0, bool)
    b = keys >> np.uint64(ID_BITS)
    starts = np.flatnonzero(np.diff(b, prepend=~b[0]))
    most = np.maximum.reduceat(totals, starts)
    return totals == np.repeat(most, np.diff(starts, append=len(b)))


def merge_counts(runs: DataFrame, n_runs: int, fan: int = FAN) -> DataFrame:
    """``radix, keys, totals``: one list of each radix, from ``run, radix, keys, totals``."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        blobs = list(zip(group["keys"], group["totals"], strict=True))
        parts = list(merge_runs(blobs))
        keys = np.concatenate([k for k, _ in parts])
        totals = np.concatenate([t for _, t in parts])
        return pd.DataFrame(
            {"radix": [key[0]], "part": [key[1]], "keys": [_pack_keys(keys)], "totals": [_packed(totals, "<u8")]}
        )

    level = runs.select("radix", F.xxhash64("run").alias("part"), "keys", "totals")
    left = max(1, n_runs)
    while True:
        left = -(-left // fan)
        dealt = level.withColumn("part", F.pmod("part", F.lit(left)))
        level = dealt.groupBy("radix", "part").applyInPandas(merge, "radix int, part long, keys binary, totals binary")
        if left == 1:
            return level.drop("part")


# -- contributions ----------------------------------------------------------------------


def _salts(runs: DataFrame, salt_bytes: int) -> Column:
    """Number of tasks of each radix, by the bytes of its records; one row per radix comes here."""
    size = F.sum(F.length("docs") + F.length("times") + F.length("sizes") + F.length("keys"))
    sizes = {r["radix"]: r["n"] for r in runs.groupBy("radix").agg(size.alias("n")).collect()}
    salts = {radix: max(1, -(-n // salt_bytes)) for radix, n in sizes.items()}
    pairs = [F.lit(x) for x in chain.from_iterable(salts.items())]
    return F.create_map(*pairs)[F.col("radix")] if pairs else F.lit(1)


def contributions(runs: DataFrame, counts: DataFrame, salt_bytes: int = SALT_BYTES) -> DataFrame:
    """``run, n_best, count_sum``: what pairs of one radix give to the documents of a run.

    Both are blobs with a number for each document up to the last with a record.
    """
    salts = _salts(runs, salt_bytes)
    records = runs.select("run", "radix", "keys", "sizes", "docs", "times").withColumn(
        "salt", F.pmod(F.xxhash64("run"), salts).cast("int")
    )
    lists = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))

    def give(records: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(records):
            known = _unpack_keys(lists["keys"].iloc[0])
            totals = _unpacked(lists["totals"].iloc[0], "<u8").astype(np.int64)
            best = highest(known, totals)
            for row in records.itertuples(index=False):
                at = np.searchsorted(known, _unpack_keys(row.keys))
                at = np.repeat(at, _unpacked(row.sizes, "<u4"))
                docs, times = _unpacked(row.docs, "<u2"), _unpacked(row.times, "<u4").astype(np.int64)
                n_best, sums = (np.zeros(int(docs.max()) + 1, np.int64) for _ in range(2))
                np.add.at(n_best, docs, times * best[at])
                np.add.at(sums, docs, times * totals[at])
                out.append((row.run, _packed(n_best, "<u4"), _packed(sums, "<u8")))
        return pd.DataFrame(out, columns=["run", "n_best", "count_sum"])

    paired = records.groupBy("radix", "salt").cogroup(lists.groupBy("radix", "salt"))
    return paired.applyInPandas(give, "run long, n_best binary, count_sum binary")


class Alignment(NamedTuple):
    """Figures of every document, and every linked pair with its count."""

    documents: DataFrame
    pairs: DataFrame


DOCUMENTS = f"doc_id long, {FIGURES}, n_best long, count_sum long, groups_sha256 string"


def _gathered(rows: DataFrame, given: DataFrame) -> DataFrame:
    columns = [c.split()[0] for c in DOCUMENTS.split(", ")]

    def gather(docs: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        n = int(docs["doc"].max()) + 1 if len(docs) else 0
        n_best, sums = (np.zeros(n, np.int64) for _ in range(2))
        for row in given.itertuples(index=False):
            part = _unpacked(row.n_best, "<u4")
            n_best[: len(part)] += part
            part = _unpacked(row.count_sum, "<u8")
            sums[: len(part)] += part.astype(np.int64)
        at = docs["doc"].to_numpy(np.int64)
        # Strings that Arrow read in pieces do not go back as one column.
        digests = docs["groups_sha256"].astype(object)
        return docs.assign(n_best=n_best[at], count_sum=sums[at], groups_sha256=digests)[columns]

    names = ["run", "doc", *[c for c in columns if c not in ("n_best", "count_sum")]]
    return rows.select(*names).groupBy("run").cogroup(given.groupBy("run")).applyInPandas(gather, DOCUMENTS)


def listed_pairs(counts: DataFrame) -> DataFrame:
    """``a_id, b_id, links, best`` of every pair from the merged lists."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, totals in zip(batch["keys"], batch["totals"], strict=True):
                keys, totals = _unpack_keys(keys), _unpacked(totals, "<u8").astype(np.int64)
                yield pd.DataFrame(
                    {
                        "a_id": (keys & np.uint64((1 << ID_BITS) - 1)).astype(np.int64),
                        "b_id": (keys >> np.uint64(ID_BITS)).astype(np.int64),
                        "links": totals,
                        "best": highest(keys, totals),
                    }
                )

    return counts.select("keys", "totals").mapInPandas(rows, "a_id long, b_id long, links long, best boolean")


def align_documents(
    docs: DataFrame,
    ranks_path: str | None = None,
    pieces_path: str | None = None,
    radices: int = RADICES,
    run_records: int = RUN_RECORDS,
    fan: int = FAN,
    salt_bytes: int = SALT_BYTES,
) -> Alignment:
    """Align the ``text`` of all ``docs`` (``doc_id, text``; other columns are left out)."""
    spilled = materialize(spill(docs, ranks_path, pieces_path, radices, run_records), "alignment-runs")
    runs = spilled.where("radix is not null")
    n_runs = runs.agg(F.count_distinct("run")).first()[0]
    counts = materialize(merge_counts(runs, n_runs, fan), "alignment-counts")
    given = contributions(runs, counts, salt_bytes)
    return Alignment(_gathered(spilled.where("radix is null"), given), listed_pairs(counts))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's groups and links, with the counts of its pairs in the corpus."""
    return align_documents(table(spark, folder, "documents")).documents
