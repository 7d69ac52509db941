"""Scanning, comparing, storing and filtering documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import frames
from lodestone.catalog import sql as q
from lodestone.catalog.registry import query, r6
from lodestone.catalog.textops import _packed, trimmed
from lodestone.functions.text import path_segments
from lodestone.operators import changes, corpus, ranking, scopes
from lodestone.operators.chunking import chunk_documents
from lodestone.operators.suites import SUITE, flat_cases
from lodestone.session import spread
from lodestone.sources.schema import upgraded

_KEY = "lang || '/' || doc_id || '.md'"


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


@query(
    "scan_documents",
    f"""SELECT source AS source_id, {_KEY} AS document_key, source || '/' || {_KEY}
          AS display_path, sha256(text) AS content_hash, strlen(text) AS size_bytes
        FROM documents""",
)
def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    return frames.documents(spark, folder).select(
        "source_id", "document_key", "display_path", "content_hash", "size_bytes"
    )


def _all_sources(spark: SparkSession, folder: str) -> DataFrame:
    documents = frames.documents(spark, folder).select(
        "source_id", "document_key", "content_hash"
    )
    turns = frames.table(spark, folder, "conversations").select(
        F.lit("talk").alias("source_id"),
        F.concat_ws("/", F.col("conv_id").cast("string"), F.concat("turn", F.lit(".md"))).alias(
            "document_key"
        ),
        F.sha2("text", 256).alias("content_hash"),
    )
    pages = frames.table(spark, folder, "pages").select(
        F.lit("web").alias("source_id"),
        F.array_join(path_segments(F.regexp_replace("url", "^[a-z]+://", "")), "/").alias(
            "document_key"
        ),
        F.sha2("html", 256).alias("content_hash"),
    )
    return documents.unionByName(turns).unionByName(pages)


_ALL = rf"""SELECT source AS source_id, {_KEY} AS document_key, sha256(text) AS content_hash
    FROM documents
  UNION ALL SELECT 'talk', conv_id || '/' || turn || '.md', sha256(text) FROM conversations
  UNION ALL SELECT 'web', array_to_string(list_filter(string_split(regexp_replace(url,
    '^[a-z]+://', ''), '/'), lambda s: s <> ''), '/'), sha256(html) FROM pages"""


@query("multi_source_union", _ALL)
def multi_source_union(spark: SparkSession, folder: str) -> DataFrame:
    return _all_sources(spark, folder)


# The stored snapshot: labelled documents, those of low quality with an older
# text, and the benchmark passages as documents that are gone by now.
_STORED = f"""SELECT source AS source_id, {_KEY} AS document_key,
    sha256(CASE WHEN quality = 1 THEN text ELSE upper(text) END) AS content_hash
  FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT 'bench', item_id || '.md', sha256(text) FROM benchmark"""
_FOUND = f"""SELECT source AS source_id, {_KEY} AS document_key, sha256(text) AS content_hash
  FROM documents"""
_CHANGES = f"""SELECT source_id, document_key, CASE WHEN s.content_hash IS NULL THEN 'added'
    WHEN f.content_hash IS NULL THEN 'deleted' WHEN f.content_hash <> s.content_hash
    THEN 'modified' ELSE 'unchanged' END AS change
  FROM ({_FOUND}) f FULL OUTER JOIN ({_STORED}) s USING (source_id, document_key)"""


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    rows = frames.table(spark, folder, "documents")
    marks = frames.table(spark, folder, "labels").select("doc_id", "quality")
    body = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.upper("text"))
    labelled = rows.join(marks, "doc_id").select(
        F.col("source").alias("source_id"),
        F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias(
            "document_key"
        ),
        F.sha2(body, 256).alias("content_hash"),
    )
    gone = frames.table(spark, folder, "benchmark").select(
        F.lit("bench").alias("source_id"),
        F.concat(F.col("item_id").cast("string"), F.lit(".md")).alias("document_key"),
        F.sha2("text", 256).alias("content_hash"),
    )
    return labelled.unionByName(gone)


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return frames.documents(spark, folder).select("source_id", "document_key", "content_hash")


@query("change_set", _CHANGES)
def change_set(spark: SparkSession, folder: str) -> DataFrame:
    return changes.change_set(_found(spark, folder), _stored(spark, folder))


@query(
    "change_counts",
    "SELECT "
    + ", ".join(
        f"count(*) FILTER (change = '{kind}') AS {kind}"
        for kind in ("added", "modified", "deleted", "unchanged")
    )
    + f" FROM ({_CHANGES})",
)
def change_counts(spark: SparkSession, folder: str) -> DataFrame:
    return changes.change_counts(change_set(spark, folder))


@query(
    "deleted_docs",
    f"SELECT source_id, document_key FROM ({_CHANGES}) WHERE change = 'deleted'",
)
def deleted_docs(spark: SparkSession, folder: str) -> DataFrame:
    gone = changes.deleted_documents(_found(spark, folder), _stored(spark, folder))
    return gone.select("source_id", "document_key")


@query(
    "index_apply",
    f"""SELECT f.source_id, f.document_key, f.content_hash, s.content_hash IS NOT NULL AS kept
        FROM ({_FOUND}) f LEFT JOIN ({_STORED}) s USING (source_id, document_key, content_hash)""",
)
def index_apply(spark: SparkSession, folder: str) -> DataFrame:
    """The stored table after an update, and which rows it kept."""
    stored = _stored(spark, folder).withColumn("kept", F.lit(True))
    found = _found(spark, folder).withColumn("kept", F.lit(False))
    return changes.apply_changes(stored, found)


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = frames.table(spark, folder, "documents").select("source").distinct()
    return rows.select(
        F.lit("main").alias("collection_id"),
        F.col("source").alias("source_id"),
        F.lit("markdown-directory").alias("kind"),
        F.concat(F.lit("docs/"), "source").alias("root_path"),
    )


def _configured(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with a toxic document, moved elsewhere, and the talk roles."""
    marks = frames.table(spark, folder, "labels").filter("toxic = 1").select("doc_id")
    rows = frames.table(spark, folder, "documents").select("doc_id", "source")
    toxic = rows.join(marks, "doc_id", "left_semi").select(F.col("source").alias("source_id"))
    roles = frames.table(spark, folder, "conversations").select(F.col("role").alias("source_id"))
    return toxic.unionByName(roles).distinct().select(
        F.lit("main").alias("collection_id"),
        "source_id",
        F.concat(F.lit("moved/"), "source_id").alias("root_path"),
    )


_CONFIGURED = """SELECT DISTINCT source AS source_id FROM documents JOIN labels USING (doc_id)
  WHERE toxic = 1 UNION SELECT DISTINCT role FROM conversations"""


@query(
    "upsert_sources",
    f"""SELECT 'main' AS collection_id, source_id, kind,
          CASE WHEN n.source_id IS NOT NULL THEN 'moved/' || source_id ELSE 'docs/' || source_id
          END AS root_path
        FROM (SELECT DISTINCT source AS source_id, 'markdown-directory' AS kind FROM documents)
          FULL OUTER JOIN ({_CONFIGURED}) n USING (source_id)""",
)
def upsert_sources(spark: SparkSession, folder: str) -> DataFrame:
    return changes.upsert(
        _sources(spark, folder), _configured(spark, folder), ["collection_id", "source_id"]
    )


@query(
    "prune_sources",
    f"""SELECT source AS source_id, {_KEY} AS document_key FROM documents
        WHERE source IN (SELECT source_id FROM ({_CONFIGURED}))""",
)
def prune_sources(spark: SparkSession, folder: str) -> DataFrame:
    documents = frames.documents(spark, folder)
    kept = changes.keep_listed_sources(documents, _configured(spark, folder))
    return kept.select("source_id", "document_key")


@query(
    "doc_snapshot",
    f"""SELECT doc_id AS id, source AS source_id, {_KEY} AS document_key,
          sha256(text) AS content_hash, 'docs/' || source AS root_path FROM documents""",
)
def doc_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    documents = frames.documents(spark, folder)
    joined = documents.join(_sources(spark, folder), ["collection_id", "source_id"])
    return joined.select(
        F.col("doc_id").alias("id"), "source_id", "document_key", "content_hash", "root_path"
    )


@query(
    "index_counts",
    q.with_ctes(
        "",
        f"""SELECT lang AS collection_id, count(DISTINCT d.doc_id) AS documents,
              count(p.doc_id) AS chunks
            FROM documents d LEFT JOIN (SELECT doc_id FROM pieces
              WHERE {trimmed("body")} <> '') p ON p.doc_id = d.doc_id
            GROUP BY lang""",
        **_packed(1800),
    ),
)
def index_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and chunks, with languages as collections."""
    lang = F.regexp_extract("document_key", "^([^/]+)/", 1)
    documents = spread(frames.documents(spark, folder), "doc_id").withColumn("collection_id", lang)
    chunks = chunk_documents(documents.select("source_id", "document_key", "content"))
    return changes.index_counts(documents, chunks)


@query(
    "schema_upgrade",
    """SELECT 2::BIGINT AS version, media_type, count(*) AS documents FROM (
         SELECT 'text/markdown' AS media_type FROM documents) GROUP BY media_type""",
)
def schema_upgrade(spark: SparkSession, folder: str) -> DataFrame:
    """Reading documents stored before media types were recorded."""
    old = frames.documents(spark, folder)
    return upgraded(old, 1).groupBy("media_type").agg(
        F.lit(2).cast("bigint").alias("version"), F.count("*").alias("documents")
    )


@query(
    "path_filter",
    f"""SELECT doc_id FROM documents
        WHERE contains(lower(source || '/' || {_KEY}), '1/de/')""",
)
def path_filter(spark: SparkSession, folder: str) -> DataFrame:
    condition = scopes.scope_condition(path="./1\\DE/")
    return frames.documents(spark, folder).filter(condition).select("doc_id")


@query(
    "scope_filter",
    """SELECT doc_id FROM documents
       WHERE source IN ('src1', 'src3', 'src19') AND contains(lower(source || '/' || lang), '/en')""",
)
def scope_filter(spark: SparkSession, folder: str) -> DataFrame:
    condition = scopes.scope_condition(
        path="/en", collection_ids=["main", "other"], source_ids=["src1", "src3", "src19"], tags=[]
    )
    return frames.documents(spark, folder).filter(condition).select("doc_id")


@query(
    "tag_filter",
    """SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id)
       WHERE coalesce(toxic, 0) = 1 OR lang = 'de'""",
)
def tag_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Documents tagged toxic, or from a source tagged with a language."""
    rows = frames.table(spark, folder, "documents").select("doc_id", "lang")
    marks = frames.table(spark, folder, "labels")
    raw = F.array(
        F.when(F.col("toxic") == 1, " Toxic "), F.when(F.col("quality") == 1, "Good"), F.lit(" ")
    )
    tagged = rows.join(marks, "doc_id", "left").select(
        "doc_id",
        scopes.clean_tags(F.array_compact(raw)).alias("document_tags"),
        F.array(F.upper("lang")).alias("source_tags"),
    )
    return tagged.filter(scopes.scope_condition(tags=["toxic", "De"])).select("doc_id")


@query(
    "corpus_stats",
    """SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents,
         sum(len(string_split(text, chr(10))[1]) + 2 + len(text))::BIGINT AS characters
       FROM documents WHERE string_split(text, chr(10))[1] <> ''""",
)
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.functions.text import embedding_text

    chunks = frames.passages(spark, folder).withColumn(
        "embedding_text", embedding_text(F.col("heading"), F.col("content"))
    )
    return corpus.corpus_stats(chunks)


@query(
    "corpus_fingerprint",
    f"""WITH lines AS (SELECT sha256(source || '/' || {_KEY} || ':0:' || doc_id || ':'
              || sha256(text)) AS line FROM documents),
        words AS (SELECT i, sum(('0x' || line[8 * i + 1:8 * i + 8])::BIGINT) % 4294967296 AS word
          FROM lines, range(0, 8) r(i) GROUP BY i)
        SELECT sha256('total:' || n || chr(10) || 'selected:' || n || chr(10)
            || (SELECT string_agg(word::BIGINT::VARCHAR, ',' ORDER BY i) FROM words)) AS fingerprint,
          n AS chunks
        FROM (SELECT count(*) AS n FROM lines)""",
)
def corpus_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of all documents as one corpus."""
    rows = frames.documents(spark, folder).select(
        F.col("doc_id").alias("chunk_id"), "display_path", F.lit(0).alias("ordinal"), "content_hash"
    )
    return corpus.corpus_fingerprint(rows).select("fingerprint", big("chunks"))


@query(
    "even_sample",
    f"""SELECT doc_id, display_path FROM (
          SELECT *, row_number() OVER (ORDER BY display_path) - 1 AS pos, count(*) OVER () AS n
          FROM (SELECT doc_id, source || '/' || {_KEY} AS display_path FROM documents))
        JOIN range(0, 64) r(i) ON pos = (i * n) // 64
        UNION ALL SELECT doc_id, source || '/' || {_KEY} FROM documents
        WHERE (SELECT count(*) FROM documents) < 64""",
)
def even_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = frames.documents(spark, folder).select("doc_id", "display_path")
    return ranking.even_sample(rows, ["display_path"], 64)


@query(
    "latency_percentiles",
    f"""SELECT event_type, count(value) AS n, {q.r6("quantile_disc(value, 0.5)")} AS p50,
          {q.r6("quantile_disc(value, 0.95)")} AS p95, {q.r6("min(value)")} AS minimum,
          {q.r6("max(value)")} AS maximum
        FROM events GROUP BY event_type""",
)
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank percentiles of the measured values per event type."""
    rows = frames.table(spark, folder, "events")
    found = ranking.nearest_rank(
        rows, "event_type", "value", {"minimum": 0.0, "p50": 0.5, "p95": 0.95, "maximum": 1.0}
    )
    return found.select(
        "event_type", "n", *[r6(name).alias(name) for name in ("p50", "p95", "minimum", "maximum")]
    )


_PROBES = """SELECT item_id, 'single-term' AS kind, 0 AS k, words[1:1] AS terms FROM w
  UNION ALL SELECT item_id, 'term-bundle', 1, words[2:4] FROM w
  UNION ALL SELECT item_id, 'alternate-vocabulary', 2, words[-2:] FROM w"""
_WORDS = r"""SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')
  AS words FROM benchmark"""


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """Three probes of every benchmark passage: first, next three, last two words."""
    rows = frames.table(spark, folder, "benchmark")
    words = F.filter(F.split("text", r"\s+"), lambda word: word != "")
    cut = rows.select("item_id", words.alias("words"))
    kinds = [
        ("single-term", F.slice("words", 1, 1)),
        ("term-bundle", F.slice("words", 2, 3)),
        (
            "alternate-vocabulary",
            F.slice("words", F.greatest(F.size("words") - 1, F.lit(1)), F.lit(2)),
        ),
    ]
    listed = F.array(
        *[
            F.struct(F.lit(name).alias("kind"), F.lit(k).alias("k"), terms.alias("terms"))
            for k, (name, terms) in enumerate(kinds)
        ]
    )
    return cut.select("item_id", F.explode(listed).alias("p")).select("item_id", "p.*")


@query(
    "suite_flatten",
    q.with_ctes(
        "",
        """SELECT 'i' || item_id || '/p' || k AS case_id, 'i' || item_id AS intent_id, kind,
             array_to_string(terms, ' ') AS query, len(terms) AS terms, item_id || '.md' AS path
           FROM p
           UNION ALL SELECT 'c' || item_id, 'c' || item_id, 'legacy', text, 1, item_id || '.md'
           FROM benchmark""",
        w=_WORDS,
        p=_PROBES,
    ),
)
def suite_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Suites of both versions as JSON texts, read back into flat cases."""
    place = F.struct(
        F.concat(F.col("item_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit("h").alias("heading"),
    )
    intents = probes(spark, folder).groupBy("item_id").agg(
        F.collect_list(
            F.struct(F.concat(F.lit("p"), F.col("k").cast("string")).alias("id"), "kind", "terms")
        ).alias("probes")
    )
    newer = intents.select(
        F.to_json(
            F.struct(
                F.lit(2).alias("version"),
                F.array(
                    F.struct(
                        F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("id"),
                        F.array(place).alias("expected"),
                        "probes",
                    )
                ).alias("intents"),
            )
        ).alias("json")
    )
    older = frames.table(spark, folder, "benchmark").select(
        F.to_json(
            F.struct(
                F.lit(1).alias("version"),
                F.array(
                    F.struct(
                        F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("id"),
                        F.col("text").alias("query"),
                        F.array(place).alias("expected"),
                    )
                ).alias("cases"),
            )
        ).alias("json")
    )
    suites = newer.unionByName(older).select(F.from_json("json", SUITE).alias("s")).select("s.*")
    return flat_cases(suites).select(
        "case_id",
        "intent_id",
        "kind",
        "query",
        F.size("terms").cast("bigint").alias("terms"),
        F.get("expected", F.lit(0))["path"].alias("path"),
    )
