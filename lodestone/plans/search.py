"""A batch of search requests over an indexed corpus."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import SearchConfig
from lodestone.errors import NavigationError
from lodestone.functions import text
from lodestone.functions.scoring import total_weight
from lodestone.operators.cells import CellIndex, nearest_in_cells
from lodestone.operators.fusion import (
    candidate_limit,
    fuse_routes,
    rank_results,
    score_candidates,
    with_relaxation,
    with_text_evidence,
)
from lodestone.operators.lexicon import with_chunk_terms
from lodestone.operators.nearest import nearest
from lodestone.operators.postings import Inverted, best_keywords, invert, query_phrases
from lodestone.operators.scanning import AskedHits, scan_keywords
from lodestone.operators.scopes import number_scopes, with_scopes
from lodestone.session import materialize

REQUEST = (
    "qid bigint, query string, query_parts array<string>, top int, path string, "
    "collection_ids array<string>, source_ids array<string>, tags array<string>, "
    "vector array<float>"
)
MOST_RESULTS = 100


@dataclass(frozen=True)
class Routes:
    """Everything a batch search computed on the way to its results."""

    requests: DataFrame
    vector: DataFrame
    keyword: DataFrame
    candidates: DataFrame


def check_request(query: str, top: int | None = None) -> None:
    if not query.strip():
        raise NavigationError("QUERY_EMPTY", "Search query cannot be empty.")
    if top is not None and (not isinstance(top, int) or not 1 <= top <= MOST_RESULTS):
        raise NavigationError("TOP_INVALID", "Result count must be a whole number from 1 to 100.")


def request_problem(query: Column, top: Column) -> Column:
    """Code of the rule that a request of a frame breaks, or null."""
    blank = query.isNull() | query.rlike(r"(?U)^\s*$")
    return F.when(blank, "QUERY_EMPTY").when((top < 1) | (top > MOST_RESULTS), "TOP_INVALID")


def requests_frame(spark: SparkSession, requests: Iterable[dict]) -> DataFrame:
    """A request batch from plain dictionaries, checked on the driver."""
    rows = []
    for number, request in enumerate(requests):
        check_request(request["query"], request.get("top"))
        rows.append({"qid": number, **request})
    return spark.createDataFrame(rows, REQUEST)


def read_requests(queries: DataFrame, config: SearchConfig) -> DataFrame:
    """Add mode, searchable terms, part terms and candidate limit to requests.

    A blank query and a result count out of range are errors, as for one request.
    """
    full = queries
    for name, kind in (
        ("query_parts", "array<string>"),
        ("top", "int"),
        ("vector", "array<float>"),
    ):
        if name not in full.columns:
            full = full.withColumn(name, F.lit(None).cast(kind))
    problem = request_problem(F.col("query"), F.col("top"))
    said = F.concat(problem, F.lit(": request "), F.col("qid").cast("string"))
    checked = F.when(problem.isNull(), F.col("query")).otherwise(F.raise_error(said).cast("string"))
    full = full.withColumn("query", checked)
    return (
        full.withColumn("mode", text.query_mode(F.col("query_parts")))
        .withColumn("terms", text.search_terms(F.col("query")))
        .withColumn("terms_weight", total_weight(F.col("terms")))
        .withColumn(
            "part_terms",
            F.when(
                F.col("mode") == "terms",
                F.transform(text.clean_parts(F.col("query_parts")), text.search_terms),
            ),
        )
        .withColumn("candidate_limit", candidate_limit(F.col("top"), config.candidate_pool))
    )


def route_batch(
    passages: DataFrame,
    queries: DataFrame,
    config: SearchConfig,
    snippets: bool = False,
    keep_routes: bool = False,
    inverted: Inverted | AskedHits | None = None,
    cells: CellIndex | None = None,
) -> Routes:
    """Both routes and all scored candidates, whatever the number of filters.

    ``inverted`` is the stored index of ``passages``, or their hits of the requests' tokens where
    no request has a filter; without it an index is built. Passages without terms get
    theirs when they are candidates. With
    ``cells`` of the passages' vectors, the vector route reads the cells it needs.
    ``keep_routes`` writes the routes' candidates, for readers of several parts.
    """
    inverted = inverted or invert(passages)
    requests = materialize(read_requests(queries, config), "requests")
    asked, table = number_scopes(requests)
    scoped = with_scopes(passages, table)
    allowed = None
    if table is not None:
        asked, scoped = materialize(asked, "scoped-requests"), materialize(
            scoped.select("chunk_id", "display_path", "start_line", "embedding", "scopes"), "scoped-passages"
        )
        allowed = scoped.select("chunk_id", "scopes")
    phrases = query_phrases(asked).join(asked.select("qid", "scope"), "qid")
    limits = asked.select("qid", "candidate_limit")
    most = requests.agg(F.max("candidate_limit")).first()[0] or 1
    if cells is None:
        vector = nearest(scoped, asked, most)
    else:
        vector = nearest_in_cells(cells, asked, most, allowed).rows
    vector = vector.join(limits, "qid")
    vector = vector.filter(F.col("vector_rank") <= F.col("candidate_limit"))
    if isinstance(inverted, AskedHits):
        if allowed is not None:
            raise ValueError("Requests with filters need an inverted index.")
        keyword = scan_keywords(inverted, phrases, most).join(limits, "qid")
    else:
        keyword = best_keywords(inverted, phrases, most, allowed).join(limits, "qid")
    keyword = keyword.filter(F.col("keyword_rank") <= F.col("candidate_limit"))
    if keep_routes:
        vector, keyword = materialize(vector, "vector"), materialize(keyword, "keyword")

    # Written, so that the planner knows how few passages are wanted: it then
    # sends their ids to the passages instead of the passages over the network.
    fused = materialize(fuse_routes(vector, keyword), "fused")
    wanted = materialize(fused.select("chunk_id").distinct(), "wanted")
    payload = passages.join(wanted, "chunk_id", "left_semi")
    if "content_terms" not in passages.columns:
        payload = with_chunk_terms(payload)
    payload = payload.select(
        *("chunk_id", "display_path", "start_line", "end_line", "heading"),
        F.concat("heading_terms", "content_terms").alias("indexed_terms"),
        *([text.snippet(F.col("content")).alias("snippet")] if snippets else []),
    )
    known = asked.select("qid", "mode", "terms", "terms_weight", "part_terms", "top")
    found = payload.join(fused, "chunk_id").join(known, "qid")
    evident = with_text_evidence(found, config.candidate_pool)
    candidates = score_candidates(with_relaxation(evident), config)
    return Routes(asked, vector, keyword, candidates)


def search(
    passages: DataFrame,
    queries: DataFrame,
    config: SearchConfig,
    snippets: bool = False,
    inverted: Inverted | AskedHits | None = None,
) -> DataFrame:
    """Ranked results of a request batch.

    ``passages`` is an index frame (see ``plans.indexing``); ``queries`` needs
    ``qid`` and ``query`` and may carry the other request columns.
    """
    ranked = rank_results(route_batch(passages, queries, config, snippets, inverted=inverted).candidates)
    return ranked.select(*RESULT_COLUMNS, *(["snippet"] if snippets else []))


RESULT_COLUMNS = (
    "qid",
    "rank",
    "chunk_id",
    "display_path",
    "start_line",
    "end_line",
    "heading",
    "score",
    "vector_rank",
    "keyword_rank",
    "distance",
    "semantic",
    "lexical",
    "fusion",
    "confidence",
    "reason",
)


def diagnostics(routes: Routes) -> DataFrame:
    """Mode, terms and candidate counts per request, also for empty ones."""
    vector = routes.vector.groupBy("qid").agg(F.count("*").alias("vector_candidates"))
    keyword = routes.keyword.groupBy("qid").agg(F.count("*").alias("keyword_candidates"))
    return (
        routes.requests.select("qid", "mode", "terms")
        .join(vector, "qid", "left")
        .join(keyword, "qid", "left")
        .fillna(0, ["vector_candidates", "keyword_candidates"])
    )
