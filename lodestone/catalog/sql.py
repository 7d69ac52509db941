"""Common table expressions the SQL checks are put together from."""

from __future__ import annotations

from lodestone.functions.text import CHINESE_CUES, ENGLISH_CUES, STOP_WORDS
from lodestone.operators.postings import B, IDF_FLOOR, K1, UNIT

LATIN = r"[\p{Latin}\p{N}_./:-]+"


def terms(text: str) -> str:
    """Distinct terms of a text expression, in locale order."""
    tokens = f"regexp_extract_all({text}, '{LATIN}')"
    whole = (
        f"list_transform({tokens}, lambda t: "
        "regexp_replace(lower(t), '^[./:-]+|[./:-]+$', '', 'g'))"
    )
    parts = (
        f"flatten(list_transform({tokens}, lambda t: regexp_split_to_array(lower("
        r"regexp_replace(t, '([a-z\d])([A-Z])', '\1 \2', 'g')), '[_./: -]+')))"
    )
    distinct = f"list_distinct(list_filter(list_concat({whole}, {parts}), lambda t: t <> ''))"
    keyed = (
        f"list_sort(list_transform({distinct}, lambda t: {{'k': icu_sort_key(t, 'en'), 't': t}}))"
    )
    return f"list_transform({keyed}, lambda s: s.t)"


def search_terms(text: str) -> str:
    words = ", ".join(f"'{word}'" for word in STOP_WORDS)
    return f"list_filter({terms(text)}, lambda t: len(t) >= 2 AND NOT list_contains([{words}], t))"


def joined(items: str) -> str:
    return f"coalesce(array_to_string({items}, ' '), '')"


def tokens(items: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({joined(items)})), '[\\p{{L}}\\p{{N}}]+')"


def mode(parts: str) -> str:
    """Query mode of a list of trimmed, non-blank parts."""
    text = joined(parts)
    cues = r"\b(?:" + "|".join(ENGLISH_CUES) + r")\b"
    return f"""CASE WHEN len({parts}) = 0 THEN 'natural'
        WHEN regexp_matches({text}, '{"|".join(CHINESE_CUES)}') THEN 'natural'
        WHEN regexp_matches({text}, '{cues}', 'i') THEN 'natural'
        WHEN len({parts}) BETWEEN 2 AND 5 THEN 'terms'
        WHEN len({parts}) = 1 AND len({text}) <= 32
             AND len(regexp_split_to_array({text}, '\\s+')) <= 3 THEN 'terms'
        ELSE 'natural' END"""


def r6(value: str) -> str:
    return f"(round({value}, 6) + 0.0)::DOUBLE"


_WEIGHT = "4"  # no Han text in the tables, so every term weighs the same

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": (
        (),
        """SELECT doc_id AS chunk_id, 'main' AS collection_id, source AS source_id, lang,
             lang || '/' || doc_id || '.md' AS document_key,
             source || '/' || lang || '/' || doc_id || '.md' AS display_path,
             1 AS start_line, len(string_split(text, chr(10))) AS end_line,
             string_split(text, chr(10))[1] AS heading, text AS content
           FROM documents""",
    ),
    "idx": (
        ("docs",),
        f"""SELECT *, {tokens("heading_terms")} AS heading_tokens,
              {tokens("content_terms")} AS content_tokens
            FROM (SELECT *, {terms("heading")} AS heading_terms,
                    {terms("content")} AS content_terms FROM docs)""",
    ),
    "req": (
        (),
        f"""SELECT *, {mode("parts")} AS mode, {search_terms("query")} AS terms
            FROM (SELECT item_id AS qid, text AS query, 10 AS top, embedding AS vector,
                    list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)),
                                lambda p: p <> '') AS parts
                  FROM benchmark LEFT JOIN embeddings ON item_id = vec_id)""",
    ),
    "ph": (
        ("req",),
        f"""SELECT qid, phrase, count(*) AS times FROM (
              SELECT qid, {joined(tokens("[term]"))} AS phrase
              FROM (SELECT qid, unnest(terms) AS term FROM req))
            WHERE phrase <> '' GROUP BY ALL""",
    ),
    "lens": (
        ("idx",),
        "SELECT chunk_id, len(heading_tokens) + len(content_tokens) AS doc_len FROM idx",
    ),
    "hits": (
        ("idx", "ph"),
        """SELECT chunk_id, phrase, sum(weight) AS hits FROM (
             SELECT chunk_id, unnest(heading_tokens) AS phrase, 4.0 AS weight FROM idx
             UNION ALL
             SELECT chunk_id, unnest(content_tokens) AS phrase, 1.0 AS weight FROM idx)
           WHERE phrase IN (SELECT phrase FROM ph) GROUP BY ALL""",
    ),
    "stats": (("lens",), "SELECT count(*) AS n, sum(doc_len) / count(*) AS average FROM lens"),
    "df": (
        ("hits", "stats"),
        f"""SELECT phrase, df, CASE WHEN raw <= 0 THEN {IDF_FLOOR} ELSE raw END AS idf FROM (
              SELECT phrase, count(*) AS df, ln((any_value(n) - count(*) + 0.5)
                / (count(*) + 0.5)) AS raw
              FROM hits, stats GROUP BY phrase)""",
    ),
    "kw": (
        ("hits", "df", "lens", "stats", "ph"),
        f"""SELECT qid, chunk_id, -sum(times * round({UNIT} * idf * hits * {K1 + 1}
                / (hits + {K1} * ({1 - B} + {B} * doc_len / average)))::BIGINT)::BIGINT
                / {UNIT} AS score
            FROM hits JOIN df USING (phrase) JOIN lens USING (chunk_id) JOIN ph USING (phrase),
              stats
            GROUP BY qid, chunk_id""",
    ),
    "kwr": (
        ("kw", "docs"),
        """SELECT qid, chunk_id, score, keyword_rank FROM (
             SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid
               ORDER BY score, display_path, start_line, chunk_id) AS keyword_rank
             FROM kw JOIN docs USING (chunk_id))
           WHERE keyword_rank <= 100""",
    ),
    "vec": (
        ("req", "docs"),
        """SELECT qid, vec_id AS chunk_id, display_path, start_line,
             list_cosine_distance(e.embedding::DOUBLE[], vector::DOUBLE[]) AS distance
           FROM req, embeddings e JOIN docs ON vec_id = chunk_id
           WHERE vector IS NOT NULL""",
    ),
    "vecr": (
        ("vec",),
        """SELECT qid, chunk_id, distance, vector_rank FROM (
             SELECT *, row_number() OVER (PARTITION BY qid
               ORDER BY distance, display_path, start_line, chunk_id) AS vector_rank FROM vec)
           WHERE vector_rank <= 100""",
    ),
    "fused": (
        ("kwr", "vecr"),
        """SELECT qid, chunk_id, distance, vector_rank, keyword_rank
           FROM vecr FULL OUTER JOIN kwr USING (qid, chunk_id)""",
    ),
    "parts": (
        ("req",),
        f"""SELECT qid, part, {search_terms("part")} AS part_terms FROM (
              SELECT qid, unnest(parts) AS part FROM req WHERE mode = 'terms')""",
    ),
    "relax": (
        ("req", "parts", "kwr", "idx"),
        """SELECT qid, count(*) FILTER (seen) >= least(2, count(*)) AS relaxed FROM (
             SELECT p.qid, p.part, bool_or(list_has_any(p.part_terms,
               list_concat(heading_terms, content_terms))) AS seen
             FROM (SELECT DISTINCT qid, part, part_terms FROM parts) p
             JOIN kwr USING (qid) JOIN idx USING (chunk_id)
             GROUP BY ALL) GROUP BY qid""",
    ),
    "cand": (
        ("fused", "idx", "req", "relax"),
        f"""SELECT f.*, display_path, start_line, end_line, idx.heading, content, mode, top,
              coalesce(relaxed, false) AS relaxed, {_WEIGHT} * len(terms) AS total,
              {_WEIGHT} * len(list_intersect(terms, list_concat(heading_terms, content_terms)))
                AS found
            FROM fused f JOIN idx USING (chunk_id) JOIN req USING (qid)
              LEFT JOIN relax USING (qid)""",
    ),
    "strengths": (
        ("cand",),
        """SELECT *, CASE WHEN relaxed THEN 0.21::DOUBLE ELSE 0.15::DOUBLE END AS weak,
             CASE WHEN found > 0 THEN sqrt((found::DOUBLE / total) * (1 - exp(-found::DOUBLE / 3)))
               ELSE 0.0 END::DOUBLE AS lexical,
             CASE WHEN distance IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0,
               (weak - distance) / (weak - 0.09::DOUBLE))) END::DOUBLE AS semantic,
             least(1.0, (coalesce(0.45::DOUBLE / (8 + vector_rank), 0)
               + coalesce(0.55::DOUBLE / (8 + keyword_rank), 0))
               / (1.0::DOUBLE / 9))::DOUBLE AS fusion,
             greatest(lexical, semantic) AS confidence
           FROM cand""",
    ),
    "scored": (
        ("strengths",),
        """SELECT *, CASE WHEN confidence >= 0.5::DOUBLE THEN 'signal'
             WHEN vector_rank <= 5 AND keyword_rank <= 5 AND confidence >= 0.35::DOUBLE
               THEN 'dual-route'
             WHEN relaxed AND vector_rank <= 3 AND distance <= weak THEN 'term-vector'
             WHEN relaxed AND keyword_rank <= 3 AND lexical >= 0.25::DOUBLE THEN 'term-keyword'
             ELSE 'rejected' END AS reason,
             least(1.0, 0.6::DOUBLE * fusion + 0.2::DOUBLE * lexical
               + 0.2::DOUBLE * semantic)::DOUBLE AS score
           FROM strengths""",
    ),
    "results": (
        ("scored",),
        """SELECT * FROM (
             SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, confidence DESC,
               vector_rank ASC NULLS LAST, keyword_rank ASC NULLS LAST,
               icu_sort_key(display_path, 'en'), start_line, chunk_id) AS rank
             FROM scored WHERE reason <> 'rejected')
           WHERE rank <= top""",
    ),
}


def with_ctes(names: str, final: str, instead: dict[str, str] | None = None, **extra: str) -> str:
    """``final`` after the named expressions and everything they build on.

    ``extra`` adds expressions of one query, in the order given, at the end;
    ``instead`` gives other bodies to expressions that build on no others.
    """
    instead = instead or {}
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{name} AS ({instead.get(name, CTES[name][1])})" for name in ordered]
    parts += [f"{name} AS ({body})" for name, body in extra.items()]
    head = "WITH RECURSIVE " if any("UNION ALL" in b for b in extra.values()) else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + final
