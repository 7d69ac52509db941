"""Exact nearest passages by cosine distance.

Every task multiplies its Arrow batches with the query matrix and keeps only
its own best ``k`` per query, so neither pairs nor vectors are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import NavigationError
from lodestone.operators.ranking import salt_when_wide, top_k
from lodestone.session import collect_bounded, materialize

QUERY_BLOCK = 4096
# Matrix products may differ from sums in order by less than this.
_SLACK = 1e-9
_CELLS = 4_000_000
OUT = "qid bigint, chunk_id bigint, display_path string, start_line bigint, distance double"
_ORDER = ["qid", "distance", "display_path", "start_line", "chunk_id"]


def matrix_of(vectors: pa.Array) -> np.ndarray:
    sizes = np.unique(np.diff(np.asarray(vectors.offsets)))
    if len(sizes) > 1:
        raise NavigationError("EMBEDDING_DIMENSION_MISMATCH", "Vectors differ in dimension.")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


class Best:
    """Running best ``k`` per query over the batches of one task."""

    def __init__(self, qids: np.ndarray, scopes: np.ndarray, vectors: np.ndarray, k: int):
        self.qids, self.scopes, self.vectors, self.k = qids, scopes, vectors, k
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.bound = np.full(len(qids), np.inf)
        self.kept: pd.DataFrame | None = None

    def add(self, rows: pd.DataFrame, vectors: np.ndarray, allowed: np.ndarray | None) -> None:
        if vectors.shape[1] != self.vectors.shape[1]:
            raise NavigationError(
                "EMBEDDING_DIMENSION_MISMATCH", "Query and passage vectors differ in dimension."
            )
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        step = max(1, _CELLS // max(1, len(rows)))
        for first in range(0, len(self.qids), step):
            block = slice(first, first + step)
            near = 1.0 - (self.vectors[block] @ vectors.T) / np.outer(self.norms[block], norms)
            if allowed is not None:
                near[~allowed[:, self.scopes[block]].T] = np.inf
            bound = self.bound[block]
            if len(rows) > self.k:
                kth = np.partition(near, self.k - 1, axis=1)[:, self.k - 1]
                bound = np.minimum(bound, kth)
            query, row = np.nonzero(np.isfinite(near) & (near <= bound[:, None] + _SLACK))
            if len(query):
                self._merge(query + first, row, rows, vectors, norms)

    def _merge(self, query, row, rows, vectors, norms) -> None:
        exact = np.empty(len(query))
        for at in range(0, len(query), 100_000):
            q, r = query[at : at + 100_000], row[at : at + 100_000]
            dots = (self.vectors[q] * vectors[r]).sum(axis=1)
            exact[at : at + 100_000] = 1.0 - dots / (self.norms[q] * norms[r])
        found = rows.iloc[row].reset_index(drop=True)
        found.insert(0, "qid", self.qids[query])
        found["distance"] = exact
        found["_q"] = query
        pool = found if self.kept is None else pd.concat([self.kept, found], ignore_index=True)
        pool = pool.sort_values(_ORDER, ignore_index=True)
        place = pool.groupby("_q").cumcount().to_numpy()
        self.kept = pool[place < self.k].reset_index(drop=True)
        full = self.kept[place[place < self.k] == self.k - 1]
        self.bound[full["_q"].to_numpy()] = full["distance"].to_numpy()

    def result(self) -> pd.DataFrame:
        names = ["qid", "chunk_id", "display_path", "start_line", "distance"]
        if self.kept is None:
            return pd.DataFrame({name: [] for name in names})
        return self.kept[names]


def scope_matrix(scopes: pa.Array, count: int) -> np.ndarray:
    sizes = np.diff(np.asarray(scopes.offsets))
    allowed = np.zeros((len(scopes), count), dtype=bool)
    owners = np.repeat(np.arange(len(scopes)), sizes)
    allowed[owners, scopes.flatten().to_numpy(zero_copy_only=False)] = True
    return allowed


def to_arrow(found: pd.DataFrame) -> list[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("qid", pa.int64()),
            ("chunk_id", pa.int64()),
            ("display_path", pa.string()),
            ("start_line", pa.int64()),
            ("distance", pa.float64()),
        ]
    )
    table = pa.Table.from_pandas(found, schema=schema, preserve_index=False)
    return table.combine_chunks().to_batches()


def _scan(passages: DataFrame, queries: list, k: int, scoped: bool) -> DataFrame:
    context = passages.sparkSession.sparkContext
    qids = np.array([row.qid for row in queries], dtype=np.int64)
    scopes = np.array([row.scope for row in queries], dtype=np.int64)
    sizes = {len(row.vector) for row in queries}
    if len(sizes) > 1:
        raise NavigationError("EMBEDDING_DIMENSION_MISMATCH", "Query vectors differ in dimension.")
    matrix = np.array([row.vector for row in queries], dtype=np.float64)
    shared = context.broadcast((qids, scopes, matrix))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, scopes, matrix = shared.value
        keeper = Best(qids, scopes, matrix, k)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = ["chunk_id", "display_path", "start_line"]
            rows = batch.select(names).to_pandas()
            allowed = None
            if scoped:
                allowed = scope_matrix(batch.column("scopes"), int(scopes.max()) + 1)
            keeper.add(rows, matrix_of(batch.column("embedding")), allowed)
        yield from to_arrow(keeper.result())

    return passages.mapInArrow(best, OUT)


def _in_blocks(passages: DataFrame, queries: DataFrame, k: int, scoped: bool, size: int) -> DataFrame:
    """A scan for each block of a request batch that is too big to hand to each task at once.

    Passages stay where they are; what a scan finds is written, so each is planned by itself.
    """
    blocks = -(-queries.count() // size)
    found = None
    for number in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == number).collect()  # about ``size`` rows
        if some:
            part = materialize(_scan(passages, some, k, scoped), "nearest-block")
            found = part if found is None else found.unionByName(part)
    return found


def nearest(
    passages: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """Best ``k`` passages per query: ``qid, chunk_id, …, distance, vector_rank``.

    ``passages`` needs ``chunk_id, display_path, start_line, embedding``;
    ``queries`` needs ``qid, vector``.  Both may carry scope numbers.
    """
    scoped = "scopes" in passages.columns and "scope" in queries.columns
    columns = ["chunk_id", "display_path", "start_line", "embedding"]
    asked = queries if "scope" in queries.columns else queries.withColumn("scope", F.lit(0))
    asked = asked.select("qid", "scope", "vector").filter(F.col("vector").isNotNull())
    rows = passages.select(
        *[F.col(c).cast("bigint") if c == "start_line" else F.col(c) for c in columns],
        *(["scopes"] if scoped else []),
    ).filter(F.col("embedding").isNotNull())
    listed = collect_bounded(asked, query_block)
    if listed is None:
        found = _in_blocks(rows, asked, k, scoped, query_block)
    elif not listed:
        found = rows.sparkSession.createDataFrame([], OUT)
    else:
        found = _scan(rows, listed, k, scoped)
    order = [F.col(name).asc() for name in _ORDER[1:]]
    salt = salt_when_wide(found, "chunk_id")
    return top_k(found, ["qid"], order, k, rank="vector_rank", salt=salt)
