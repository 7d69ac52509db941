"""Hard negatives: close vectors of another label, found through segment summaries.

Every vector is cut into ``SEGMENTS`` segments, and of each the mean and the deviation
are stored beside the row. Over a segment of n components the product of two vectors is
n * mean * mean, give or take n * deviation * deviation (Cauchy and Schwarz), so the
sums over all segments bound a score from both sides. Bounds of fewer, longer
segments follow from the stored ones and come first: what they cannot decide is
bounded by the next level, and only what no level decides is scored exactly.

1. **Positives.** Of the rows of an anchor's label, the first ``n_positives``. In a
   batch of rows the highest lower bounds give a cutoff; rows whose upper bound is
   below it are left out.
2. **Negatives.** Of the rows of other labels whose score is in the window below an
   anchor and positive's score, the first ``n_negatives``. Rows are left out when
   their bounds miss the window, or when enough rows are in it for certain and above.

Anchors go out in blocks of about ``ANCHOR_BLOCK``, whose size is bounded whatever the
table; each block is one pass over the stored rows, which stay where they are. A task
hands on what may be an answer: at most ``n`` rows of an anchor and window. Passes are
written, so a lost executor costs at most one of them.

Rows with a null id, label or vector, an empty vector, or a component that is null or
not finite take no part. Vectors meet those of their own length. An id counts once: of
several rows the one of the smallest label, then vector. Scores are of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.registry import query, table
from lodestone.session import materialize

SEGMENTS = 16
LEVELS = (1, 4, 16)
ANCHOR_BLOCK = 8192
#: Pairs that a task holds at a time.
CELLS = 1 << 21
#: Below this share of pairs left they are bounded one by one.
SPARSE = 1 / 16
EXACT = float(2**53)
#: Ends of windows without a limit; whole numbers, so that large scores stay apart.
LEAST, MOST = -(2**62), 2**62
#: Bounds are widened by this share of the vectors' lengths, beyond what rounding can do.
SLACK = 1e-9

STORED = "vec_id long, label int, ints array<long>, means binary, deviations binary"


# -- summaries --------------------------------------------------------------------------


def _edges(width: int, segments: int) -> np.ndarray:
    return np.linspace(0, width, min(segments, width) + 1).astype(int)


def summaries(vectors: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment of every row."""
    edges = _edges(vectors.shape[1], segments)
    sizes = np.diff(edges)
    x = vectors.astype(np.float64)
    means = np.add.reduceat(x, edges[:-1], axis=1) / sizes
    apart = (x - np.repeat(means, sizes, axis=1)) ** 2
    return means, np.sqrt(np.add.reduceat(apart, edges[:-1], axis=1) / sizes)


class Level(NamedTuple):
    """Summaries of one level, scaled so that products are sums over components."""

    means: np.ndarray
    deviations: np.ndarray


def levels(means: np.ndarray, deviations: np.ndarray, width: int) -> list[Level]:
    """Levels of ever shorter segments, joined from the stored ones."""
    sizes = np.diff(_edges(width, SEGMENTS)).astype(np.float64)
    out = []
    for n in LEVELS:
        if n > len(sizes) and out and out[-1].means.shape[1] == len(sizes):
            break
        starts = _edges(len(sizes), n)[:-1]
        total = np.add.reduceat(sizes, starts)
        mean = np.add.reduceat(means * sizes, starts, axis=1) / total
        square = np.add.reduceat((deviations**2 + means**2) * sizes, starts, axis=1) / total
        apart = np.sqrt(np.maximum(square - mean**2, 0.0))
        out.append(Level(mean * np.sqrt(total), apart * np.sqrt(total)))
    return out


class Block(NamedTuple):
    """Rows of one vector length."""

    ids: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    norms: np.ndarray
    levels: list[Level]


def blocks_of(rows: pd.DataFrame) -> Iterator[Block]:
    """The rows of a frame of ``STORED``, by their lengths."""
    if not len(rows):
        return
    widths = rows["ints"].map(len).to_numpy()
    for width in np.unique(widths).tolist():
        part = rows[widths == width]
        ints = np.stack(part["ints"].to_numpy()).astype(np.int64)
        means, deviations = (
            np.frombuffer(b"".join(part[c]), np.float64).reshape(len(part), -1) for c in ("means", "deviations")
        )
        norms = np.sqrt((ints.astype(np.float64) ** 2).sum(axis=1))
        yield Block(
            part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), ints, norms,
            levels(means, deviations, width),
        )


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows."""
    if _small(a, b):
        return np.einsum("ij,ij->i", a, b)
    pairs = zip(a.tolist(), b.tolist(), strict=True)
    return np.array([sum(x * y for x, y in zip(p, q, strict=True)) for p, q in pairs], np.int64)


def _small(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of these rows are exact in floating point."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT


# -- one task ---------------------------------------------------------------------------


class Kept:
    """The best entries of every window so far: ``(window, score, id)``."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.window = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.cutoff = np.full(n, -np.inf)

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(window):
            return
        window, score, ids = (
            np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.ids, ids))
        )
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(window, prepend=-1))
        place = np.arange(len(window)) - np.repeat(starts, np.diff(starts, append=len(window)))
        keep = place < self.size
        self.window, self.score, self.ids = window[keep], score[keep], ids[keep]
        last = place == self.size - 1
        self.cutoff[window[last]] = score[last]


class Windows(NamedTuple):
    """Score windows of every anchor: ``low`` and ``high`` of (anchor, slot); unused slots are empty."""

    low: np.ndarray
    high: np.ndarray


class Tally(NamedTuple):
    """How many pairs there were, and how many no level of bounds decided."""

    pairs: int
    exact: int


def refine(anchors: Block, windows: Windows, kept: Kept, rows: Block, same: bool) -> Tally:
    """Add to ``kept`` what ``rows`` offer to the ``windows`` of ``anchors``.

    ``same`` asks for rows of an anchor's label, else for rows of another. Bounds are
    products of whole blocks while they leave many pairs, and of single pairs then.
    """
    pairs = exact = 0
    slots, size = windows.low.shape[1], kept.size
    step = max(1, CELLS // max(1, len(rows.ids)))
    for first in range(0, len(anchors.ids), step):
        own = slice(first, first + step)
        low, high = windows.low[own], windows.high[own]
        used = low <= high
        any_low = np.where(used, low, MOST).min(axis=1)
        any_high = np.where(used, high, LEAST).max(axis=1)
        # A pair within these is in every window of its anchor.
        all_low = np.where(used, low, LEAST).max(axis=1)
        all_high = np.where(used, high, MOST).min(axis=1)
        reached = np.where(used, kept.cutoff.reshape(-1, slots)[own], np.inf).min(axis=1)
        cutoff = np.maximum(any_low, reached)
        alive = (anchors.labels[own][:, None] == rows.labels[None, :]) == same
        alive &= anchors.ids[own][:, None] != rows.ids[None, :]
        alive &= used.any(axis=1)[:, None]
        pairs += int(alive.sum())
        slack = SLACK * np.outer(anchors.norms[own], rows.norms) + SLACK
        anchor = row = None
        for at, r in zip(anchors.levels, rows.levels, strict=True):
            if anchor is None:
                middle = at.means[own] @ r.means.T
                spread = at.deviations[own] @ r.deviations.T + slack
                lower, upper = middle - spread, middle + spread
                sure = alive & (lower >= all_low[:, None]) & (upper <= all_high[:, None])
                if len(rows.ids) >= size and sure.any():
                    sure = np.where(sure, lower, -np.inf)
                    cutoff = np.maximum(cutoff, np.partition(sure, -size, axis=1)[:, -size])
                alive &= (upper >= cutoff[:, None]) & (lower <= any_high[:, None])
                if alive.sum() < SPARSE * alive.size:
                    anchor, row = np.nonzero(alive)
            else:
                keep = np.empty(len(anchor), bool)
                for part in _parts(len(anchor)):
                    i, j = anchor[part] + first, row[part]
                    middle = np.einsum("ij,ij->i", at.means[i], r.means[j])
                    spread = np.einsum("ij,ij->i", at.deviations[i], r.deviations[j])
                    spread += slack[anchor[part], j]
                    keep[part] = (middle + spread >= cutoff[anchor[part]]) & (middle - spread <= any_high[anchor[part]])
                anchor, row = anchor[keep], row[keep]
        if anchor is None and _small(anchors.ints[own], rows.ints):
            exact += int(alive.sum())
            scores = anchors.ints[own].astype(np.float64) @ rows.ints.T.astype(np.float64)
            anchor, row = np.nonzero(alive & (scores >= cutoff[:, None]) & (scores <= any_high[:, None]))
            score = scores[anchor, row].astype(np.int64)
        else:
            if anchor is None:
                anchor, row = np.nonzero(alive)
            exact += len(anchor)
            score = np.empty(len(anchor), np.int64)
            for part in _parts(len(anchor)):
                score[part] = exact_scores(anchors.ints[anchor[part] + first], rows.ints[row[part]])
        order = np.lexsort((rows.ids[row], -score, anchor))
        anchor, score, ids = anchor[order], score[order], rows.ids[row[order]]
        for slot in range(slots):
            inside = (score >= low[anchor, slot]) & (score <= high[anchor, slot])
            who, what, which = anchor[inside], score[inside], ids[inside]
            starts = np.flatnonzero(np.diff(who, prepend=-1))
            place = np.arange(len(who)) - np.repeat(starts, np.diff(starts, append=len(who)))
            keep = place < size
            kept.add((who[keep] + first) * slots + slot, what[keep], which[keep])
    return Tally(pairs, exact)


def _parts(n: int, size: int = 1 << 17) -> Iterator[slice]:
    for at in range(0, n, size):
        yield slice(at, at + size)


# -- the corpus -------------------------------------------------------------------------


def summarised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``STORED`` of the rows of ``vec_id, label, embedding`` that take part, one of each id."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    usable = rows.select("vec_id", "label", "embedding").where(
        x.isNotNull() & (F.size(x) > 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    )
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    scaled = usable.where(finite).select(F.col("vec_id").cast("long"), F.col("label").cast("int"), ints.alias("ints"))
    once = scaled.groupBy("vec_id").agg(F.min(F.struct("label", "ints")).alias("row")).select("vec_id", "row.*")

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            widths = rows["ints"].map(len).to_numpy()
            for width in np.unique(widths).tolist():
                part = rows[widths == width]
                means, deviations = summaries(np.stack(part["ints"].to_numpy()))
                yield part.assign(
                    means=[m.tobytes() for m in means], deviations=[d.tobytes() for d in deviations]
                )

    return once.mapInPandas(summarise, STORED)


def _blocks(anchors: DataFrame) -> Iterator[list[Block]]:
    """The anchors in blocks of a bounded size, dealt by a hash of the rows."""
    n = -(-anchors.count() // ANCHOR_BLOCK)
    for i in range(n):
        # About ANCHOR_BLOCK rows: ids differ, so the hash deals them evenly.
        some = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i)
        yield list(blocks_of(some.toPandas().sort_values("vec_id")))


FOUND = "anchor_id long, bound long, vec_id long, score long"


def _pass(rows: DataFrame, blocks: list[Block], windows: list[Windows], size: int, same: bool) -> DataFrame:
    """Candidates of every window, ``size`` of each from a task; ``bound`` is a window's upper end."""
    shared = rows.sparkSession.sparkContext.broadcast((blocks, windows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, windows = shared.value
        by_width = {b.ints.shape[1]: i for i, b in enumerate(blocks)}
        kept = [Kept(w.low.size, size) for w in windows]
        for batch in batches:
            for part in blocks_of(batch):
                i = by_width.get(part.ints.shape[1])
                if i is not None:
                    refine(blocks[i], windows[i], kept[i], part, same)
        for block, w, found in zip(blocks, windows, kept, strict=True):
            yield pd.DataFrame(
                {
                    "anchor_id": block.ids[found.window // w.low.shape[1]],
                    "bound": w.high.ravel()[found.window],
                    "vec_id": found.ids,
                    "score": found.score,
                }
            )

    return rows.mapInPandas(run, FOUND)


def _first(found: DataFrame, keys: list[str], size: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= size)


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _positive_windows(blocks: list[Block]) -> list[Windows]:
    return [Windows(np.full((len(b.ids), 1), LEAST), np.full((len(b.ids), 1), MOST)) for b in blocks]


def _negative_windows(blocks: list[Block], scores: pd.DataFrame, slots: int, least: int, whole: int) -> list[Windows]:
    """Each anchor's different positive scores as windows from ``least / whole`` of them."""
    own = scores[["anchor_id", "score"]].drop_duplicates()
    slot = own.groupby("anchor_id").cumcount().to_numpy()
    high = own["score"].to_numpy(np.int64)
    low = -(-least * high // whole)
    out = []
    for b in blocks:
        place = pd.Index(b.ids).get_indexer(own["anchor_id"])
        here = (place >= 0) & (low <= high)
        windows = Windows(np.full((len(b.ids), slots), MOST), np.full((len(b.ids), slots), LEAST))
        windows.low[place[here], slot[here]] = low[here]
        windows.high[place[here], slot[here]] = high[here]
        out.append(windows)
    return out


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    n_positives: int = 5,
    n_negatives: int = 5,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Both frames are stored tables of ``STORED``. Negatives are those of another label
    with ``80 * positive_score <= 100 * negative_score <= 100 * positive_score``;
    first come higher scores, then smaller ids.
    """
    spark = rows.sparkSession
    positives, negatives = [], []
    for blocks in _blocks(anchors):
        found = _pass(rows, blocks, _positive_windows(blocks), n_positives, same=True)
        first = _first(found, ["anchor_id"], n_positives, "place")
        known = materialize(first.select("anchor_id", F.col("vec_id").alias("positive_id"), "score"), "positives")
        positives.append(known)
        # At most n_positives rows for each anchor of the block.
        scores = known.select("anchor_id", "score").toPandas()
        windows = _negative_windows(blocks, scores, n_positives, 80, 100)
        near = _pass(rows, blocks, windows, n_negatives, same=False)
        negatives.append(materialize(_first(near, ["anchor_id", "bound"], n_negatives, "rank"), "negatives"))
    chosen = _union(positives, spark, "anchor_id long, positive_id long, score long")
    near = _union(negatives, spark, f"{FOUND}, rank int")
    chosen = chosen.withColumnRenamed("score", "positive_score")
    near = near.select(
        "anchor_id", F.col("bound").alias("positive_score"), "rank",
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    return chosen.join(near, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


CHECK = """
WITH vectors AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS ints
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.ints, c.ints), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors a JOIN vectors c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


@query("op12_hard_negatives", CHECK)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, among all vectors."""
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), "embedding")
    stored = materialize(summarised(rows), "summaries")
    return mine(stored, stored.where("vec_id % 100 = 0"))
