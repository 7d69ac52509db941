"""Terms, chunking, masking, headings and model inputs over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import frames
from lodestone.catalog import sql as q
from lodestone.catalog.registry import query, r6
from lodestone.functions import text, tokens, vectors
from lodestone.operators.parsing import parse_documents
from lodestone.operators.chunking import chunk_documents, section_paths
from lodestone.operators.corpus import length_buckets, vector_problems
from lodestone.session import spread

PACK_CHARS = 300


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


@query(
    "index_terms",
    f"""SELECT doc_id, len(terms) AS n_terms, terms[1] AS first_term, terms[-1] AS last_term,
          sha256(array_to_string(terms, ' ')) AS terms_sha
        FROM (SELECT doc_id, {q.terms("text")} AS terms FROM documents)""",
)
def index_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(frames.table(spark, folder, "documents"), "doc_id")
    terms = rows.select("doc_id", text.index_terms(F.col("text")).alias("terms"))
    return terms.select(
        "doc_id",
        F.size("terms").cast("bigint").alias("n_terms"),
        F.get("terms", F.lit(0)).alias("first_term"),
        F.element_at("terms", -1).alias("last_term"),
        F.sha2(F.array_join("terms", " "), 256).alias("terms_sha"),
    )


_QUERY_TERMS = f"SELECT item_id, {q.search_terms('text')} AS terms FROM benchmark"


@query("query_terms", f"SELECT item_id, array_to_string(terms, ' ') AS terms FROM ({_QUERY_TERMS})")
def query_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = frames.table(spark, folder, "benchmark")
    terms = text.search_terms(F.col("text"))
    return rows.select("item_id", F.array_join(terms, " ").alias("terms"))


@query(
    "match_query",
    f"""SELECT item_id, array_to_string(list_transform(terms, lambda t: '"' || t || '"'), ' OR ')
          AS match_query FROM ({_QUERY_TERMS})""",
)
def match_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = frames.table(spark, folder, "benchmark")
    return rows.select(
        "item_id", text.match_query(text.search_terms(F.col("text"))).alias("match_query")
    )


# Greedy packing of the lines of every document into pieces of ``size``
# characters; longer lines are cut.  One step of the recursion reads one line.
_LINES = """SELECT doc_id, line, n, len(line) AS size FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"""


def _packed(limit: int) -> dict[str, str]:
    return {
        "lines": _LINES,
        "walk": f"""SELECT doc_id, n, 1 AS start, size AS used, size > {limit} AS cut
              FROM lines WHERE n = 1
            UNION ALL
            SELECT l.doc_id, l.n,
              CASE WHEN w.cut OR l.size > {limit} OR w.used + 1 + l.size > {limit}
                THEN l.n ELSE w.start END,
              CASE WHEN w.cut OR l.size > {limit} OR w.used + 1 + l.size > {limit}
                THEN l.size ELSE w.used + 1 + l.size END,
              l.size > {limit}
            FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.n = w.n + 1""",
        "pieces": f"""SELECT doc_id, start, max(n) AS stop, 0 AS part,
              string_agg(line, chr(10) ORDER BY n) AS body
            FROM walk JOIN lines USING (doc_id, n) WHERE NOT cut GROUP BY doc_id, start
            UNION ALL
            SELECT doc_id, n, n, part, line[part * {limit} + 1:(part + 1) * {limit}]
            FROM lines, unnest(range(0, size // {limit} + 1)) p(part)
            WHERE size > {limit} AND part * {limit} < size""",
    }


PACKED = _packed(1800)


def trimmed(body: str) -> str:
    return rf"regexp_replace({body}, '^\s+|\s+$', '', 'g')"


@query(
    "chunk_lines",
    q.with_ctes(
        "",
        f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, part) - 1
              AS ordinal, start::BIGINT AS start_line, stop::BIGINT AS end_line,
              sha256(chr(10) || body) AS content_hash
            FROM (SELECT doc_id, start, stop, part, {trimmed("body")} AS body FROM pieces)
            WHERE body <> ''""",
        **_packed(1800),
    ),
)
def chunk_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every document under the default size limit."""
    rows = spread(frames.table(spark, folder, "documents"), "doc_id")
    chunks = chunk_documents(rows.select("doc_id", F.col("text").alias("content")))
    return chunks.select(
        "doc_id", big("ordinal"), big("start_line"), big("end_line"), "content_hash"
    )


@query(
    "mixed_chunks",
    q.with_ctes(
        "",
        f"""SELECT doc_id, media_type, CASE WHEN media_type = 'text/plain' THEN '' ELSE lang END AS heading,
              1::BIGINT AS first_line, coalesce(last_line + 2, 1)::BIGINT AS last_line
            FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'text/plain' ELSE 'text/markdown' END
                  AS media_type FROM documents WHERE text IS NOT NULL)
              LEFT JOIN (SELECT doc_id, max(stop) AS last_line FROM pieces WHERE {trimmed("body")} <> ''
                GROUP BY doc_id) USING (doc_id)
            WHERE media_type = 'text/plain' OR last_line IS NOT NULL""",
        **PACKED,
    ),
)
def mixed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a title line, every third as plain text, the others as Markdown, in one pass."""
    rows = spread(frames.table(spark, folder, "documents"), "doc_id").where("text is not null")
    kind = F.when(F.col("doc_id") % 3 == 0, "text/plain").otherwise("text/markdown")
    content = F.concat(F.lit("# "), "lang", F.lit("\n\n"), "text")
    chunks = parse_documents(rows.select("doc_id", kind.alias("media_type"), content.alias("content")))
    return chunks.groupBy("doc_id", "media_type").agg(
        F.max(F.array_join("heading", " > ")).alias("heading"),
        F.min("start_line").cast("bigint").alias("first_line"),
        F.max("end_line").cast("bigint").alias("last_line"),
    )


@query(
    "line_split",
    q.with_ctes(
        "",
        f"""SELECT doc_id, count(*) AS pieces, max(len(body)) AS longest, sum(len(body))::BIGINT AS kept,
              max(stop)::BIGINT AS last_line
            FROM (SELECT doc_id, stop, {trimmed("body")} AS body FROM pieces)
            WHERE body <> '' GROUP BY doc_id""",
        **_packed(PACK_CHARS),
    ),
)
def line_split(spark: SparkSession, folder: str) -> DataFrame:
    """Splitting of over-long blocks, summed up per document."""
    rows = spread(frames.table(spark, folder, "documents"), "doc_id")
    documents = rows.select("doc_id", F.col("text").alias("content"))
    chunks = chunk_documents(documents, PACK_CHARS)
    size = F.length("content").cast("bigint")
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("pieces"),
        F.max(size).alias("longest"),
        F.sum(size).alias("kept"),
        F.max("end_line").cast("bigint").alias("last_line"),
    )


def _turn_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn as a Markdown page of two headings and paragraphs."""
    rows = frames.table(spark, folder, "conversations")
    content = F.concat(
        F.lit("# "), "role", F.lit("\n\n## turn *"), F.col("turn").cast("string"),
        F.lit("* of `"), F.col("conv_id").cast("string"), F.lit("`\n\n"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")),
    )
    return spread(rows, "conv_id", "turn").select("conv_id", "turn", content.alias("content"))


# The same pages as numbered paragraphs: paragraph p is line 2p + 3.
_PARAGRAPHS = """SELECT conv_id, turn, role, p, line, len(line) AS size FROM (
  SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS p FROM conversations)"""
_SECTION = "role || ' > turn ' || turn || ' of ' || conv_id"


@query(
    "heading_path",
    f"""SELECT conv_id, turn, {_SECTION} AS heading, 3::BIGINT AS title_line,
          (2 * len(string_split(text, chr(10))) + 3)::BIGINT AS end_line,
          len(string_split(text, chr(10)))::BIGINT AS blocks FROM conversations""",
)
def heading_path(spark: SparkSession, folder: str) -> DataFrame:
    """Heading path and line range of every section of the turn pages."""
    sections = section_paths(_turn_pages(spark, folder))
    return sections.select(
        "conv_id",
        "turn",
        F.array_join("heading", " > ").alias("heading"),
        F.col("title_first").cast("bigint").alias("title_line"),
        big("end_line"),
        big("blocks"),
    )


@query(
    "block_pack",
    q.with_ctes(
        "",
        f"""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY start, part)
              - 1 AS ordinal, {_SECTION} AS heading,
              CASE WHEN row_number() OVER (PARTITION BY conv_id, turn ORDER BY start, part) = 1
                THEN 3 ELSE 2 * start + 3 END::BIGINT AS start_line,
              (2 * stop + 3)::BIGINT AS end_line, len(body)::BIGINT AS chars
            FROM pieces JOIN conversations USING (conv_id, turn)""",
        lines=_PARAGRAPHS,
        walk=f"""SELECT conv_id, turn, p, 1 AS start, size AS used, size > {PACK_CHARS} AS cut
              FROM lines WHERE p = 1
            UNION ALL
            SELECT l.conv_id, l.turn, l.p,
              CASE WHEN w.cut OR l.size > {PACK_CHARS} OR w.used + 2 + l.size > {PACK_CHARS}
                THEN l.p ELSE w.start END,
              CASE WHEN w.cut OR l.size > {PACK_CHARS} OR w.used + 2 + l.size > {PACK_CHARS}
                THEN l.size ELSE w.used + 2 + l.size END,
              l.size > {PACK_CHARS}
            FROM walk w JOIN lines l
              ON l.conv_id = w.conv_id AND l.turn = w.turn AND l.p = w.p + 1""",
        raw=f"""SELECT conv_id, turn, start, max(p) AS stop, 0 AS part,
              string_agg(line, chr(10) || chr(10) ORDER BY p) AS body
            FROM walk JOIN lines USING (conv_id, turn, p) WHERE NOT cut
            GROUP BY conv_id, turn, start
            UNION ALL
            SELECT conv_id, turn, p, p, part, line[part * {PACK_CHARS} + 1:(part + 1) * {PACK_CHARS}]
            FROM lines, unnest(range(0, size // {PACK_CHARS} + 1)) s(part)
            WHERE size > {PACK_CHARS} AND part * {PACK_CHARS} < size""",
        numbered="""SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY start, part)
              AS place FROM raw""",
        pieces=f"""SELECT conv_id, turn, start, stop, part, {trimmed('''
              CASE WHEN place = 1 AND (part > 0 OR (stop = start AND cutline)) THEN
                '## turn *' || turn || '* of `' || conv_id || '`' || chr(10) || body
              WHEN place = 1 THEN
                '## turn *' || turn || '* of `' || conv_id || '`' || chr(10) || chr(10) || body
              ELSE body END''')} AS body
            FROM (SELECT n.*, EXISTS (SELECT 1 FROM lines l WHERE l.conv_id = n.conv_id
                AND l.turn = n.turn AND l.p = n.start AND l.size > {PACK_CHARS}) AS cutline
              FROM numbered n)""",
    ),
)
def block_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Packing of the turn pages' paragraphs under their headings."""
    chunks = chunk_documents(_turn_pages(spark, folder), PACK_CHARS)
    return chunks.select(
        "conv_id",
        "turn",
        big("ordinal"),
        F.array_join("heading", " > ").alias("heading"),
        big("start_line"),
        big("end_line"),
        F.length("content").cast("bigint").alias("chars"),
    )


@query(
    "embedding_text",
    f"""SELECT conv_id, turn, len({_SECTION}) + 2 + len('## turn *' || turn || '* of `' || conv_id
          || '`') + 2 + len(replace(text, chr(10), chr(10) || chr(10))) AS chars,
          md5({_SECTION} || chr(10) || chr(10) || '## turn *' || turn || '* of `' || conv_id || '`'
          || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10))) AS text_key
        FROM conversations""",
)
def embedding_text(spark: SparkSession, folder: str) -> DataFrame:
    """What a model would be given for every turn page kept in one piece."""
    chunks = chunk_documents(_turn_pages(spark, folder), 32_000)
    return chunks.select(
        "conv_id",
        "turn",
        F.length("embedding_text").cast("bigint").alias("chars"),
        F.md5("embedding_text").alias("text_key"),
    )


@query(
    "mask_block",
    """SELECT page_id, masked, md5(CASE WHEN masked THEN html[:first - 1]
          || regexp_replace(html[first:stop - 1], '[^\\r\\n]', ' ', 'g') || html[stop:]
          ELSE html END) AS text_key
        FROM (SELECT page_id, html, strpos(html, '<script>') AS first,
            strpos(html, '</script>') + 9 AS stop,
            (len(html) - len(replace(html, '<script>', ''))) = 8
            AND (len(html) - len(replace(html, '</script>', ''))) = 9
            AND strpos(html, '<script>') < strpos(html, '</script>') AS masked
          FROM pages)""",
)
def mask_block(spark: SparkSession, folder: str) -> DataFrame:
    """Blanking the one script of every page."""
    rows = frames.table(spark, folder, "pages")
    masked = text.mask_block(F.col("html"), "<script>", "</script>")
    return rows.select(
        "page_id", (masked != F.col("html")).alias("masked"), F.md5(masked).alias("text_key")
    )


@query(
    "heading_display",
    r"""SELECT page_id, array_to_string(CASE WHEN len(unique_parts) > 0 AND suffix(
            regexp_replace(lower(unique_parts[1]), '[^\p{L}\p{N}]', '', 'g'), stem)
            THEN unique_parts[2:] ELSE unique_parts END, ' > ') AS heading
        FROM (SELECT page_id, stem, list_filter(list_transform(generate_series(1, len(parts)),
            lambda i: CASE WHEN i = 1 OR keys[i] <> keys[i - 1] THEN parts[i] END),
            lambda p: p IS NOT NULL) AS unique_parts
          FROM (SELECT *, list_transform(parts, lambda p:
              regexp_replace(lower(p), '[^\p{L}\p{N}]', '', 'g')) AS keys
            FROM (SELECT page_id, list_filter(string_split(regexp_replace(
                regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/', '/'), '/'),
                lambda p: p <> '') || regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS parts,
              regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1)),
                '[^\p{L}\p{N}]', '', 'g') AS stem FROM pages)))""",
)
def heading_display(spark: SparkSession, folder: str) -> DataFrame:
    """Clean-up of the link trail of every page, named after its folder."""
    rows = frames.table(spark, folder, "pages")
    trail = F.concat(
        text.path_segments(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)),
        F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)),
    )
    name = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1), F.lit(".md"))
    return rows.select(
        "page_id", F.array_join(text.display_heading(name, trail), " > ").alias("heading")
    )


_IDS = """SELECT doc_id, list_transform(string_split(text, ' '), lambda w: len(w)::BIGINT) AS ids
  FROM documents"""


@query(
    "head_tail",
    f"""SELECT doc_id, len(kept) AS n, list_sum(kept)::BIGINT AS total, kept[16]::BIGINT AS middle,
          len(plain) AS n_plain, list_sum(plain)::BIGINT AS total_plain
        FROM (SELECT doc_id, CASE WHEN len(ids) <= 32 THEN ids
              ELSE ids[:16] || [99]::BIGINT[] || ids[-15:] END AS kept,
            CASE WHEN len(ids) <= 32 THEN ids ELSE ids[:16] || ids[-16:] END AS plain
          FROM ({_IDS}))""",
)
def head_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Head-and-tail truncation with word lengths standing in for token ids."""
    rows = frames.table(spark, folder, "documents")
    ids = F.transform(F.split("text", " "), lambda word: F.length(word).cast("bigint"))
    cut = rows.select("doc_id", ids.alias("ids")).select(
        "doc_id",
        tokens.head_and_tail(F.col("ids"), 32, 99).alias("kept"),
        tokens.head_and_tail_static(F.col("ids"), 32).alias("plain"),
    )

    def total(name: str):
        return F.aggregate(name, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    return cut.select(
        "doc_id",
        F.size("kept").cast("bigint").alias("n"),
        total("kept").alias("total"),
        F.get("kept", F.lit(15)).alias("middle"),
        F.size("plain").cast("bigint").alias("n_plain"),
        total("plain").alias("total_plain"),
    )


@query(
    "padding",
    """SELECT item_id, batch, width, len(ids) AS used,
          array_to_string(ids || list_resize([]::BIGINT[], width - len(ids), 0::BIGINT), ' ')
            AS input_ids
        FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width
          FROM (SELECT item_id, item_id // 8 AS batch,
              list_transform(string_split(text, ' '), lambda w: len(w)::BIGINT) AS ids
            FROM benchmark))""",
)
def padding(spark: SparkSession, folder: str) -> DataFrame:
    """Padding every batch of eight inputs to its longest."""
    from pyspark.sql import Window

    rows = frames.table(spark, folder, "benchmark")
    ids = F.transform(F.split("text", " "), lambda word: F.length(word).cast("bigint"))
    batches = rows.select("item_id", F.expr("item_id div 8").alias("batch"), ids.alias("ids"))
    width = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    wide = batches.withColumn("width", width)
    mask = tokens.attention_mask(F.col("ids"), F.col("width"))
    return wide.select(
        "item_id",
        "batch",
        big("width"),
        F.aggregate(mask, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("used"),
        F.array_join(tokens.padded(F.col("ids"), F.col("width"), 0), " ").alias("input_ids"),
    )


@query(
    "bucket_order",
    """SELECT doc_id, len(text) AS length, row_number() OVER (ORDER BY len(text), doc_id) - 1
          AS position, (row_number() OVER (ORDER BY len(text), doc_id) - 1) // 8 AS batch
        FROM documents""",
)
def bucket_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = frames.table(spark, folder, "documents")
    placed = length_buckets(rows, "doc_id", "text", 8)
    return placed.select("doc_id", big("length"), big("position"), big("batch"))


@query(
    "vector_validate",
    f"""SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'dimension'
          WHEN abs(norm - 1) > 0.02 THEN 'not-normalized' ELSE 'ok' END AS problem,
          {q.r6("norm")} AS norm
        FROM (SELECT *, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
          FROM embeddings)""",
)
def vector_validate(spark: SparkSession, folder: str) -> DataFrame:
    rows = vector_problems(frames.table(spark, folder, "embeddings"), 64)
    return rows.select("vec_id", "problem", r6("norm").alias("norm"))


# A vector of 64 read as 8 tokens of 8 values, the last ones masked by label.
_HIDDEN = """SELECT vec_id, list_transform(range(0, 8), lambda t:
    list_transform(range(0, 8), lambda c: embedding[t * 8 + c + 1]::DOUBLE)) AS hidden,
    8 - (label % 4) AS used FROM embeddings"""


def _hidden(spark: SparkSession, folder: str) -> DataFrame:
    rows = frames.table(spark, folder, "embeddings")
    value = vectors.as_doubles(F.col("embedding"))
    hidden = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(value, t * 8 + 1, F.lit(8))
    )
    used = 8 - F.col("label") % 4
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.when(t < used, 1).otherwise(0))
    return rows.select("vec_id", hidden.alias("hidden"), mask.alias("mask"))


def _first_two(vector: str) -> list:
    return [
        r6(F.get(vector, F.lit(0))).alias("first"),
        r6(F.get(vector, F.lit(7))).alias("last"),
        r6(vectors.norm(F.col(vector))).alias("norm"),
    ]


def _pooled_sql(vector: str, source: str) -> str:
    unit = f"list_transform({vector}, lambda x: x / sqrt(list_inner_product({vector}, {vector})))"
    return f"""SELECT vec_id, {q.r6("unit[1]")} AS first, {q.r6("unit[8]")} AS last,
          {q.r6("sqrt(list_inner_product(unit, unit))")} AS norm
        FROM (SELECT vec_id, {unit} AS unit FROM ({source}))"""


@query(
    "mean_pool",
    _pooled_sql(
        "v",
        f"""SELECT vec_id, list_transform(range(1, 9), lambda c: list_sum(list_transform(
              hidden[:used], lambda row: row[c])) / used) AS v FROM ({_HIDDEN})""",
    ),
)
def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    pooled = vectors.mean_pooled(F.col("hidden"), F.col("mask"))
    return _hidden(spark, folder).select("vec_id", pooled.alias("v")).select(
        "vec_id", *_first_two("v")
    )


@query("cls_pool", _pooled_sql("v", f"SELECT vec_id, hidden[1] AS v FROM ({_HIDDEN})"))
def cls_pool(spark: SparkSession, folder: str) -> DataFrame:
    pooled = vectors.first_token_pooled(F.col("hidden"))
    return _hidden(spark, folder).select("vec_id", pooled.alias("v")).select(
        "vec_id", *_first_two("v")
    )


@query(
    "matryoshka",
    _pooled_sql("v", "SELECT vec_id, embedding[:8]::DOUBLE[] AS v FROM embeddings"),
)
def matryoshka(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings cut to their first eight values and brought to unit length."""
    rows = frames.table(spark, folder, "embeddings")
    cut = vectors.truncated(vectors.as_doubles(F.col("embedding")), 8)
    return rows.select("vec_id", cut.alias("v")).select("vec_id", *_first_two("v"))
