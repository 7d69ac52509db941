"""Retrieval quality: expected places, ranks, metrics, gates and coverage."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import frames
from lodestone.catalog import sql as q
from lodestone.catalog.ingest import _PROBES, _WORDS, probes
from lodestone.catalog.registry import query, r6
from lodestone.config import SearchConfig
from lodestone.operators import metrics
from lodestone.operators.corpus import located
from lodestone.operators.fusion import rank_results
from lodestone.operators.literal import scanned
from lodestone.plans.search import Routes, route_batch, search
from lodestone.session import materialize

CONFIG = SearchConfig()
KINDS = metrics.KINDS
GATES = {
    "positive_recall_at_5": 0.9,
    "positive_top_1": 0.7,
    "exact_top_1": 0.9,
    "negative_rejection": 0.9,
    "determinism": 1.0,
}


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


def passage_places(spark: SparkSession, folder: str) -> DataFrame:
    """``item_id, chunk_id`` of every document holding a benchmark passage."""
    items = frames.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern")
    )
    found = scanned(frames.texts(spark, folder), items)
    return found.select(F.col("pattern_id").alias("item_id"), F.col("id").alias("chunk_id"))


_PLACES = """SELECT item_id, doc_id AS chunk_id, source || '/' || lang || '/' || doc_id || '.md'
    AS display_path
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)"""


@query("passage_places", f"SELECT item_id, chunk_id FROM ({_PLACES})")
def passage_places_query(spark: SparkSession, folder: str) -> DataFrame:
    return passage_places(spark, folder)


def _expected(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    paths = frames.documents(spark, folder).select(
        F.col("doc_id").alias("chunk_id"), "display_path"
    )
    return places.join(paths, "chunk_id")


# ---- probes: three short queries per passage; one that is found nowhere expects nothing ----


class Probed(NamedTuple):
    cases: DataFrame
    expected: DataFrame
    requests: DataFrame


def _probed(spark: SparkSession, folder: str) -> Probed:
    """Flat cases, their expected places and their search requests."""
    places = materialize(_expected(spark, folder, passage_places(spark, folder)), "places")
    cases = probes(spark, folder).select(
        (F.col("item_id") * 3 + F.col("k")).alias("case_id"),
        F.col("item_id").alias("intent_id"),
        "kind",
        "terms",
    )
    cases = materialize(cases, "cases")
    expected = cases.select("case_id", F.col("intent_id").alias("item_id")).join(places, "item_id")
    vectors = frames.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("intent_id"), F.col("embedding").alias("vector")
    )
    requests = cases.join(vectors, "intent_id", "left").select(
        F.col("case_id").alias("qid"),
        F.array_join("terms", " ").alias("query"),
        F.col("terms").alias("query_parts"),
        F.lit(5).alias("top"),
        "vector",
    )
    return Probed(cases, expected.select("case_id", "chunk_id", "display_path"), requests)


_PROBE_REQ = f"""SELECT qid, query, 5 AS top, vector, parts, {q.mode("parts")} AS mode,
    {q.search_terms("query")} AS terms
  FROM (SELECT p.item_id * 3 + k AS qid, array_to_string(terms, ' ') AS query,
      embedding AS vector, list_filter(list_transform(terms, lambda t: trim(t)),
        lambda t: t <> '') AS parts
    FROM ({_PROBES.replace("FROM w", f"FROM ({_WORDS}) w")}) p LEFT JOIN embeddings ON p.item_id = vec_id)"""
_PROBE_CASES = f"""SELECT p.item_id * 3 + k AS case_id, p.item_id AS intent_id, kind, terms
  FROM ({_PROBES.replace("FROM w", f"FROM ({_WORDS}) w")}) p"""
_WANTED = f"""SELECT case_id, chunk_id, display_path FROM ({_PROBE_CASES}) c
  JOIN ({_PLACES}) ON item_id = intent_id"""
_LITERAL = f"""SELECT t.case_id, count(DISTINCT d.doc_id) AS literal_candidates,
    bool_or(w.chunk_id IS NOT NULL) AS literal_match
  FROM (SELECT case_id, unnest(terms) AS term FROM ({_PROBE_CASES})) t
    JOIN documents d ON contains(lower(d.text), lower(t.term))
    LEFT JOIN ({_WANTED}) w ON w.case_id = t.case_id AND w.chunk_id = d.doc_id
  GROUP BY t.case_id"""


def _literal(spark: SparkSession, folder: str, probed: Probed) -> DataFrame:
    """Documents that contain any word of a case literally, per case."""
    terms = probed.cases.select("case_id", F.explode("terms").alias("term"))
    words = terms.select("case_id", F.lower("term").alias("pattern"))  # compared in lower case
    numbered = words.select("pattern").distinct().withColumn(
        "pattern_id", F.monotonically_increasing_id()
    )
    numbered = materialize(numbered, "words")
    found = scanned(frames.texts(spark, folder), numbered, any_case=True)
    found = found.withColumnRenamed("id", "chunk_id")
    asked = words.join(numbered, "pattern").select("case_id", "pattern_id").distinct()
    pairs = found.join(asked, "pattern_id").select("case_id", "chunk_id").distinct()
    wanted = probed.expected.select("case_id", "chunk_id").distinct().withColumn(
        "hit", F.lit(True)
    )
    return pairs.join(wanted, ["case_id", "chunk_id"], "left").groupBy("case_id").agg(
        F.count("*").alias("literal_candidates"),
        F.bool_or(F.coalesce("hit", F.lit(False))).alias("literal_match"),
    )


@query("literal_baseline", _LITERAL)
def literal_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return _literal(spark, folder, _probed(spark, folder))


def _run(spark: SparkSession, folder: str, probed: Probed) -> Routes:
    return route_batch(
        frames.searched_passages(spark, folder),
        probed.requests,
        CONFIG,
        keep_routes=True,
        inverted=frames.asked_hits(spark, folder),
    )


def _ranks(found: DataFrame, rank: str, expected: DataFrame) -> DataFrame:
    """Best rank per case of an expected document among a route's results."""
    named = found.select(F.col("qid").alias("case_id"), "chunk_id", F.col(rank).alias("rank"))
    wanted = expected.select("case_id", "chunk_id").distinct()
    return named.join(wanted, ["case_id", "chunk_id"]).groupBy("case_id").agg(
        F.min("rank").alias("expected_rank")
    )


def _observed(probed: Probed, ranks: DataFrame) -> DataFrame:
    """One row per case, with a missing rank where nothing expected came."""
    return probed.cases.select("case_id", "intent_id", "kind").join(ranks, "case_id", "left")


def _sql_ranks(source: str, rank: str) -> str:
    return f"""SELECT qid AS case_id, min({rank}) AS expected_rank FROM {source}
      JOIN wanted w ON w.case_id = qid AND w.chunk_id = {source}.chunk_id GROUP BY qid"""


_PROBE_EXTRA = {"wanted": _WANTED, "cases": _PROBE_CASES}


def _probe_sql(names: str, final: str, **extra: str) -> str:
    return q.with_ctes(names, final, {"req": _PROBE_REQ}, **_PROBE_EXTRA, **extra)


@query(
    "eval_rank",
    _probe_sql(
        "kwr",
        "SELECT case_id, kind, expected_rank FROM cases LEFT JOIN ranks USING (case_id)",
        ranks=_sql_ranks("kwr", "keyword_rank"),
    ),
)
def eval_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Where the keyword route ranked an expected document, per probe."""
    probed = _probed(spark, folder)
    ranks = _ranks(_run(spark, folder, probed).keyword, "keyword_rank", probed.expected)
    return _observed(probed, ranks).select("case_id", "kind", big("expected_rank"))


_CORE = ", ".join(
    f"{q.r6(expression)} AS {name}"
    for name, expression in (
        ("recall_at_5", "avg(CASE WHEN expected_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END)"),
        ("top_1", "avg(CASE WHEN expected_rank = 1 THEN 1.0::DOUBLE ELSE 0 END)"),
        ("mrr", "avg(coalesce(1.0::DOUBLE / expected_rank, 0))"),
        ("stability", "1.0::DOUBLE"),
    )
)


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.select(
        *[
            r6(field.name).alias(field.name)
            if field.dataType.typeName() == "double"
            else big(field.name)
            if field.dataType.typeName() in ("integer", "long")
            else F.col(field.name)
            for field in frame.schema.fields
        ]
    )


@query(
    "bench_metrics",
    _probe_sql(
        "kwr",
        f"SELECT {_CORE} FROM cases LEFT JOIN ranks USING (case_id)",
        ranks=_sql_ranks("kwr", "keyword_rank"),
    ),
)
def bench_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark means of the keyword route, run twice for its stability."""
    probed = _probed(spark, folder)
    first, second = _run(spark, folder, probed), _run(spark, folder, probed)
    named = [
        run.keyword.select(F.col("qid").alias("case_id"), "chunk_id", F.col("keyword_rank").alias("rank"))
        for run in (first, second)
    ]
    stable = metrics.stable_cases(*named, ["chunk_id"], depth=5)
    ranks = _ranks(first.keyword, "keyword_rank", probed.expected)
    observed = _observed(probed, ranks).join(stable, "case_id", "left").fillna(True, ["stable"])
    return _rounded(observed.agg(*metrics.core_metrics()))


@query(
    "stability",
    _probe_sql("results", "SELECT DISTINCT qid AS case_id, true AS stable FROM results"),
)
def stability(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a repeated hybrid search returns the same rows, per probe."""
    probed = _probed(spark, folder)
    runs = [
        rank_results(_run(spark, folder, probed).candidates).withColumnRenamed("qid", "case_id")
        for _ in range(2)
    ]
    columns = ["display_path", "start_line", "end_line", "heading", "score"]
    return metrics.stable_cases(*runs, columns)


def _hybrid_observed(spark: SparkSession, folder: str) -> tuple[Probed, DataFrame]:
    probed = _probed(spark, folder)
    results = rank_results(_run(spark, folder, probed).candidates)
    observed = _observed(probed, _ranks(results, "rank", probed.expected))
    literal = _literal(spark, folder, probed)
    full = observed.join(literal, "case_id", "left").fillna(
        {"literal_candidates": 0, "literal_match": False}
    )
    return probed, full.withColumn("stable", F.lit(True))


_OBSERVED = {
    "ranks": _sql_ranks("results", "rank"),
    "literal": _LITERAL,
    "observed": """SELECT cases.*, expected_rank, coalesce(expected_rank <= 5, false) AS hit,
        coalesce(literal_match, false) AS literal_match,
        coalesce(literal_candidates, 0) AS literal_candidates
      FROM cases LEFT JOIN ranks USING (case_id) LEFT JOIN literal USING (case_id)""",
}


def _share(hits: str, among: str) -> str:
    return q.r6(f"CASE WHEN {among} > 0 THEN ({hits})::DOUBLE / ({among}) ELSE 0 END")


@query(
    "intent_metrics",
    _probe_sql(
        "results",
        f"""SELECT count(*) AS intents, sum(probes)::BIGINT AS probes,
              {q.r6("avg(hits::DOUBLE / probes)")} AS macro_recall_at_5,
              {q.r6("avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END)")} AS any_recall_at_5,
              {_share("sum(literal)", "sum(probes)")} AS literal_target_rate,
              sum(probes - literal)::BIGINT AS rescue_eligible,
              sum(rescued)::BIGINT AS rescue_hits_at_5,
              {_share("sum(rescued)", "sum(probes - literal)")} AS rescue_rate_at_5,
              sum(crowded)::BIGINT AS compression_eligible,
              sum(compressed)::BIGINT AS compression_hits_at_5,
              {_share("sum(compressed)", "sum(crowded)")} AS compression_rate_at_5
            FROM (SELECT intent_id, count(*) AS probes, count(*) FILTER (hit) AS hits,
                count(*) FILTER (literal_match) AS literal,
                count(*) FILTER (NOT literal_match AND hit) AS rescued,
                count(*) FILTER (literal_match AND literal_candidates > 5) AS crowded,
                count(*) FILTER (literal_match AND literal_candidates > 5 AND hit) AS compressed
              FROM observed GROUP BY intent_id)""",
        **_OBSERVED,
    ),
)
def intent_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.intent_metrics(_hybrid_observed(spark, folder)[1]))


@query(
    "kind_metrics",
    _probe_sql(
        "results",
        f"""SELECT kind, count(*) AS probes, {_CORE},
              count(*) FILTER (NOT literal_match) AS literal_misses,
              {_share("count(*) FILTER (NOT literal_match AND hit)",
                      "count(*) FILTER (NOT literal_match)")} AS semantic_rescue_rate_at_5
            FROM observed GROUP BY kind""",
        **_OBSERVED,
    ),
)
def kind_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.kind_metrics(_hybrid_observed(spark, folder)[1]))


@query(
    "route_coverage",
    _probe_sql(
        "results",
        f"""SELECT {q.r6("avg(v::INT)")} AS vector_recall_at_5,
              {q.r6("avg(k::INT)")} AS keyword_recall_at_5,
              {q.r6("avg((v OR k)::INT)")} AS union_recall_at_5,
              {q.r6("avg(h::INT)")} AS hybrid_recall_at_5,
              count(*) FILTER (v OR k) AS union_hits,
              count(*) FILTER ((v OR k) AND h) AS retained_union_hits,
              {_share("count(*) FILTER ((v OR k) AND h)", "count(*) FILTER (v OR k)")}
                AS union_retention_rate_at_5
            FROM (SELECT coalesce(a.expected_rank <= 5, false) AS v,
                coalesce(b.expected_rank <= 5, false) AS k,
                coalesce(c.expected_rank <= 5, false) AS h
              FROM cases LEFT JOIN va a USING (case_id) LEFT JOIN ka b USING (case_id)
                LEFT JOIN ha c USING (case_id))""",
        va=_sql_ranks("vecr", "vector_rank"),
        ka=_sql_ranks("kwr", "keyword_rank"),
        ha=_sql_ranks("results", "rank"),
    ),
)
def route_coverage(spark: SparkSession, folder: str) -> DataFrame:
    probed = _probed(spark, folder)
    routes = _run(spark, folder, probed)
    observed = [
        _observed(probed, _ranks(found, rank, probed.expected))
        for found, rank in (
            (routes.vector, "vector_rank"),
            (routes.keyword, "keyword_rank"),
            (rank_results(routes.candidates), "rank"),
        )
    ]
    return _rounded(metrics.route_coverage(*observed))


# ---- whole passages: positive, exact and negative cases ----


def _cases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Passages as cases: negative without a holder, exact with exactly one."""
    places = materialize(_expected(spark, folder, passage_places(spark, folder)), "places")
    owners = places.groupBy("item_id").agg(F.count("*").alias("n"))
    category = (
        F.when(F.col("n").isNull(), "negative").when(F.col("n") == 1, "exact").otherwise("semantic")
    )
    cases = (
        frames.table(spark, folder, "benchmark")
        .select("item_id")
        .join(owners, "item_id", "left")
        .select(F.col("item_id").alias("case_id"), category.alias("category"))
    )
    return cases, places.withColumnRenamed("item_id", "case_id")


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    cases, expected = _cases(spark, folder)
    index = frames.searched_passages(spark, folder)
    asked = frames.requests(spark, folder).withColumn("top", F.lit(5))
    runs = [
        materialize(
            search(index, asked, CONFIG, inverted=frames.asked_hits(spark, folder))
            .withColumnRenamed("qid", "case_id")
            .withColumn("score", F.round("score", 4)),
            "run",
        )
        for _ in range(2)
    ]
    columns = ["display_path", "start_line", "end_line", "heading", "score"]
    stable = metrics.stable_cases(*runs, columns).withColumnRenamed("stable", "deterministic")
    ranks = metrics.expected_rank(runs[0], expected.select("case_id", "display_path"))
    return (
        cases.join(ranks, "case_id", "left")
        .join(metrics.first_results(runs[0]), "case_id", "left")
        .join(stable, "case_id", "left")
        .fillna({"results": 0, "deterministic": True})
    )


_CASE_REQ = q.CTES["req"][1].replace("10 AS top", "5 AS top")
_CASE_EXTRA = {
    "owners": f"SELECT item_id, count(*) AS n FROM ({_PLACES}) GROUP BY item_id",
    "cases": """SELECT b.item_id AS case_id, CASE WHEN n IS NULL THEN 'negative' WHEN n = 1
        THEN 'exact' ELSE 'semantic' END AS category
      FROM benchmark b LEFT JOIN owners USING (item_id)""",
    "ranks": f"""SELECT qid AS case_id, min(rank) AS expected_rank FROM results
      JOIN ({_PLACES}) p ON p.item_id = qid AND p.chunk_id = results.chunk_id GROUP BY qid""",
    "firsts": """SELECT qid AS case_id, count(*) AS results,
        max(CASE WHEN rank = 1 THEN display_path || ':' || start_line END) AS first
      FROM results GROUP BY qid""",
    "observed": """SELECT cases.*, expected_rank, coalesce(results, 0) AS results, first
      FROM cases LEFT JOIN ranks USING (case_id) LEFT JOIN firsts USING (case_id)""",
}
_METRIC_LIST = (
    ("positive_recall_at_5", "CASE WHEN expected_rank <= 5 THEN 1.0 ELSE 0 END", "<> 'negative'"),
    ("positive_top_1", "CASE WHEN expected_rank = 1 THEN 1.0 ELSE 0 END", "<> 'negative'"),
    ("mrr", "CASE WHEN expected_rank <= 5 THEN 1.0::DOUBLE / expected_rank ELSE 0 END",
     "<> 'negative'"),
    ("exact_top_1", "CASE WHEN expected_rank = 1 THEN 1.0 ELSE 0 END", "= 'exact'"),
    ("negative_rejection", "CASE WHEN results = 0 THEN 1.0 ELSE 0 END", "= 'negative'"),
    ("determinism", "1.0", "<> ''"),
)
_METRICS = "SELECT " + ", ".join(
    q.r6(f"coalesce(avg(({value})::DOUBLE) FILTER (category {among}), 0)") + f" AS {name}"
    for name, value, among in _METRIC_LIST
) + " FROM observed"


def _case_sql(final: str, **extra: str) -> str:
    return q.with_ctes("results", final, {"req": _CASE_REQ}, **_CASE_EXTRA, **extra)


@query("eval_metrics", _case_sql(_METRICS))
def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.product_metrics(_observations(spark, folder)))


@query(
    "eval_failures",
    _case_sql("""SELECT case_id, case_id || ': expected no result, got '
          || coalesce(first, 'empty') AS message
        FROM observed WHERE category = 'negative' AND results > 0
        UNION ALL SELECT case_id, case_id || ': expected location missing; first was '
          || coalesce(first, 'empty') FROM observed
        WHERE category <> 'negative' AND NOT coalesce(expected_rank <= 5, false)
        UNION ALL SELECT case_id, case_id || ': exact term expected at rank 1, got '
          || coalesce(expected_rank::VARCHAR, 'missing') FROM observed
        WHERE category = 'exact' AND NOT coalesce(expected_rank = 1, false)"""),
)
def eval_failures(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.failure_messages(_observations(spark, folder))


@query(
    "eval_gate",
    _case_sql(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS name, {name} AS value, {least}::DOUBLE AS threshold,
                {name} >= {least} AS passed FROM figures"""
            for name, least in GATES.items()
        ),
        figures=_METRICS,
    ),
)
def eval_gate(spark: SparkSession, folder: str) -> DataFrame:
    figures = metrics.product_metrics(_observations(spark, folder))
    checks = metrics.threshold_checks(figures, GATES)
    return checks.withColumn("value", r6("value"))


@query(
    "location_lookup",
    q.with_ctes("results", "SELECT qid, rank, chunk_id, display_path FROM results"),
)
def location_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Passage ids of the hybrid results, found again by path and lines."""
    index = frames.searched_passages(spark, folder)
    asked, inverted = frames.requests(spark, folder), frames.asked_hits(spark, folder)
    results = search(index, asked, CONFIG, inverted=inverted).drop("chunk_id")
    found = located(results, index)
    return found.select("qid", big("rank"), "chunk_id", "display_path")
