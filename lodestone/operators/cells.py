"""An exact vector index: cells with a centre and a radius.

Vectors lie on the unit sphere, where the distance between points is a metric. Each goes
to the cell of its nearest centre, and a cell keeps the largest distance of its members.
No member can be nearer to a query than the centre's distance less that radius.

A batch is answered in two rounds. The cells nearest to a query that have ``k`` members
give its first ``k`` and so a distance that ``k`` passages reach; then only cells
that can hold something nearer are read. Results equal those of a full scan.

Centres are a bounded sample of the vectors, taken in the order of a hash; every vector is
in a cell. Queries go out in blocks of at most ``QUERY_BLOCK`` rows, and each block reads
the cells it wants from the stored table, which is never copied.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import NavigationError
from lodestone.operators.nearest import OUT, QUERY_BLOCK, Best, matrix_of, scope_matrix, to_arrow
from lodestone.operators.ranking import salt_when_wide, top_k
from lodestone.session import materialize, scratch_root

MOST_CELLS = 4096
CELL_BUCKETS = 32
#: Beyond what rounding can do to a distance on the unit sphere.
SLACK = 1e-6
ROWS = "chunk_id bigint, display_path string, start_line bigint, embedding array<float>, cell int, away double"


class CellIndex(NamedTuple):
    """Stored rows of passages by cell; the centres, radii and sizes of the cells."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray


class Found(NamedTuple):
    """Results, and how many pairs of a query and a cell there were and were read."""

    rows: DataFrame
    pairs: int
    read: int


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / norms


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between points of the unit sphere."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _centres(vectors: DataFrame, count: int) -> np.ndarray:
    sample = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(count).select("embedding").toArrow()
    if not sample.num_rows:
        return np.zeros((0, 1))
    points = _unit(matrix_of(sample["embedding"].combine_chunks()))
    return np.unique(points[np.isfinite(points).all(axis=1)], axis=0)


def index_cells(passages: DataFrame, cells: int | None = None) -> CellIndex:
    """Assign and write ``chunk_id, display_path, start_line, embedding``.

    Passages without a vector are left out, as are vectors of no length, which
    are at no distance from anything.
    """
    spark = passages.sparkSession
    rows = passages.select(
        "chunk_id", "display_path", F.col("start_line").cast("bigint"), F.col("embedding").cast("array<float>")
    ).where("embedding is not null")
    n = rows.count()
    centres = _centres(rows, min(MOST_CELLS, cells or math.isqrt(n) + 1))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if not batch.num_rows or not len(centres):
                continue
            points = _unit(matrix_of(batch.column("embedding")))
            if points.shape[1] != centres.shape[1]:
                raise NavigationError("EMBEDDING_DIMENSION_MISMATCH", "Vectors differ in dimension.")
            usable = np.isfinite(points).all(axis=1)
            points = np.where(usable[:, None], points, 0.0)
            away = _chords(points, centres)
            cell = away.argmin(axis=1)
            told = batch.append_column("cell", pa.array(cell.astype(np.int32)))
            told = told.append_column("away", pa.array(away[np.arange(len(cell)), cell]))
            yield told.filter(pa.array(usable))

    folder = os.path.join(scratch_root(spark), "lodestone", f"cells-{uuid.uuid4().hex}")
    assigned = rows.mapInArrow(assign, ROWS).withColumn("bucket", F.col("cell") % CELL_BUCKETS)
    dealt = assigned.hint("rebalance", "bucket").sortWithinPartitions("bucket", "cell")
    dealt.write.partitionBy("bucket").parquet(folder)
    stored = spark.read.schema(f"{ROWS}, bucket int").parquet(folder)
    # One row for each of at most MOST_CELLS cells.
    facts = stored.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("size")).toArrow()
    radius, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    at = facts["cell"].to_numpy()
    radius[at], size[at] = facts["radius"].to_numpy(), facts["size"].to_numpy()
    return CellIndex(stored, centres, radius, size)


def _scan(index: CellIndex, rows: DataFrame, block: tuple, wanted: np.ndarray, k: int) -> DataFrame:
    """Best ``k`` of each query of a block among the cells it wants: ``wanted`` is (cell, query)."""
    cells = np.flatnonzero(wanted.any(axis=1))
    buckets = np.unique(cells % CELL_BUCKETS).tolist()
    some = rows.where(F.col("bucket").isin(buckets))
    if len(cells) < len(index.size):
        some = some.where(F.col("cell").isin(cells.tolist()))
    shared = rows.sparkSession.sparkContext.broadcast((*block, wanted))
    scoped = "scopes" in rows.columns

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, scopes, vectors, wanted = shared.value
        keeper = Best(qids, np.arange(len(qids)), vectors, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            allowed = wanted[batch.column("cell").to_numpy()]
            if scoped:
                allowed = allowed & scope_matrix(batch.column("scopes"), int(scopes.max()) + 1)[:, scopes]
            places = batch.select(["chunk_id", "display_path", "start_line"]).to_pandas()
            keeper.add(places, matrix_of(batch.column("embedding")), allowed)
        yield from to_arrow(keeper.result())

    return some.drop("bucket", "away").mapInArrow(best, OUT)


def _kth(found: DataFrame, qids: np.ndarray, k: int) -> np.ndarray:
    """The k-th distance of each query as one on the sphere; infinite where there are fewer."""
    last = top_k(found, ["qid"], [F.col("distance").asc()], k, rank="place").where(F.col("place") == k)
    known = last.select("qid", "distance").toArrow()  # one row for each query of a block
    place = pd.Series(known["distance"].to_numpy(), index=known["qid"].to_numpy()).reindex(qids).to_numpy()
    with np.errstate(invalid="ignore"):
        reach = np.sqrt(np.maximum(0.0, 2.0 * place)) + SLACK
    return np.where(np.isnan(reach), np.inf, reach)


def nearest_in_cells(index: CellIndex, queries: DataFrame, k: int, scopes: DataFrame | None = None) -> Found:
    """As :func:`nearest.nearest` over the indexed passages.

    With ``scopes`` (``chunk_id, scopes``), passages must be in their query's ``scope``.
    """
    asked = queries if "scope" in queries.columns else queries.withColumn("scope", F.lit(0))
    asked = materialize(
        asked.select("qid", "scope", "vector").where("vector is not null"), "vector-queries"
    )
    rows = index.rows if scopes is None else index.rows.join(scopes, "chunk_id")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts, pairs, read = [], 0, 0
    for number in range(blocks):
        # About QUERY_BLOCK rows of a hash of the request's number.
        some = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == number).orderBy("qid").toArrow()
        if not some.num_rows or not len(index.size):
            continue
        vectors = matrix_of(some["vector"].combine_chunks())
        if vectors.shape[1] != index.centres.shape[1]:
            raise NavigationError("EMBEDDING_DIMENSION_MISMATCH", "Query and passage vectors differ in dimension.")
        block = (some["qid"].to_numpy(), some["scope"].to_numpy().astype(np.int64), vectors)
        away = _chords(np.nan_to_num(_unit(vectors)), index.centres).T
        order = np.argsort(away, axis=0, kind="stable")
        before = np.cumsum(index.size[order], axis=0) - index.size[order]
        first = np.zeros(away.shape, bool)
        np.put_along_axis(first, order, before < k, axis=0)
        near = materialize(_scan(index, rows, block, first, k), "near-cells")
        reach = _kth(near, block[0], k)
        more = (away - index.radius[:, None] <= reach[None, :] + SLACK) & ~first & (index.size > 0)[:, None]
        parts.append(near)
        if more.any():
            parts.append(_scan(index, rows, block, more, k))
        pairs += away.size
        read += int(first.sum() + more.sum())
    found = parts[0] if parts else asked.sparkSession.createDataFrame([], OUT)
    for part in parts[1:]:
        found = found.unionByName(part)
    order = [F.col(name).asc() for name in ("distance", "display_path", "start_line", "chunk_id")]
    ranked = top_k(found, ["qid"], order, k, rank="vector_rank", salt=salt_when_wide(found, "chunk_id"))
    return Found(ranked, pairs, read)
