"""URL filter: rules first, then a blocked Bloom filter and an exact join.

A page is judged by the longest rule that fits its host and path. Pages that no
rule fits are looked up in a list of canonical URLs. The list is folded into a
blocked Bloom filter, a table of at most ``max_blocks`` rows, which is broadcast
to the pages. Pages that miss it are certainly not listed and never move; only
possible hits are shuffled to an exact join with the list.

Everything is DataFrame expressions. The broadcast is bounded by ``MAX_BLOCKS``
rows of nine integers, however long the list is; a list too long for it makes
more possible hits, not wrong answers. One URL that holds a large share of the
pages is the probe side of a join whose other side has each URL once, so
adaptive execution may split it.

Null and malformed URLs have an empty host and path, fit no rule, are never
listed and are allowed. Repeated pages are judged each by itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.registry import query, table
from lodestone.session import materialize

#: Eight 32-bit words a block, one bit of each set by a key.
WORDS = 8
KEYS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 18

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(found)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without a last slash, sorted plain parameters.

    The scheme, the fragment and the parameters ``ref`` and ``utm_…`` are left
    out. A URL without a host has none (null).
    """
    query_part = F.regexp_extract(
        F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1
    )
    plain = F.filter(
        F.split(query_part, "&", -1),
        lambda p: (p != "") & ~p.startswith("utm_") & ~p.startswith("ref="),
    )
    joined = F.array_join(F.array_sort(plain), "&")
    host = F.regexp_replace(host_of(url), "^www[.]", "")
    path = F.regexp_replace(path_of(url), "/$", "")
    return F.when(
        host != "", F.concat(host, path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    )


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (length, rule, verdict) of the longest fitting rule, else null."""
    fitting = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(
                F.lit(len(r.host) + len(r.path)).alias("length"),
                F.lit(r.host + r.path).alias("rule"),
                F.lit(r.verdict).alias("verdict"),
            ),
        )
        for r in rules
    ]
    if not fitting:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fitting)))


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit(1))
    return [
        F.call_function(
            "shiftleft", F.lit(1), F.shiftrightunsigned(bits, 5 * j).bitwiseAND(F.lit(31)).cast("int")
        )
        for j in range(WORDS)
    ]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("int")


def bloom_blocks(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter: one row for each block that holds a key."""
    masked = keys.select(
        _block(F.col(column), blocks).alias("block"),
        *[m.alias(f"w{j}") for j, m in enumerate(_masks(F.col(column)))],
    )
    return masked.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)])


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule],
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``listed`` has a column ``canonical``; repeated and null entries count for nothing.
    """
    listed = materialize(
        listed.select("canonical").where("canonical is not null").distinct(), "url-list"
    )
    blocks = 1
    for_keys = listed.count()
    while blocks < max_blocks and blocks * KEYS_PER_BLOCK < for_keys:
        blocks *= 2
    url = F.col("url")
    judged = pages.select("page_id", "url").select(
        "page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")
    )
    judged = judged.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    out = ["page_id", "host", "path"]
    ruled = judged.where("best is not null").select(*out, "best.rule", "best.verdict")

    def verdict(value: str) -> list[Column]:
        return [F.lit(None).cast("string").alias("rule"), F.lit(value).alias("verdict")]

    rest = judged.where("best is null").select(*out, canonical_url(url).alias("canonical"))
    masks = [m.alias(f"m{j}") for j, m in enumerate(_masks(F.col("canonical")))]
    probed = rest.select(
        "*", F.when(F.col("canonical").isNotNull(), _block(F.col("canonical"), blocks)).alias("block"), *masks
    ).join(F.broadcast(bloom_blocks(listed, "canonical", blocks)), "block", "left")
    possible = F.col("w0").isNotNull()
    for j in range(WORDS):
        possible = possible & (F.col(f"w{j}").bitwiseAND(F.col(f"m{j}")) == F.col(f"m{j}"))
    probed = probed.withColumn("possible", F.coalesce(possible, F.lit(False)))
    missed = probed.where(~F.col("possible")).select(*out, *verdict("allow"))
    hits = probed.where("possible").select(*out, "canonical")
    exact = hits.join(
        listed.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left"
    )
    exact = exact.select(
        *out,
        F.lit(None).cast("string").alias("rule"),
        F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"),
    )
    return ruled.unionByName(missed).unionByName(exact)


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

CHECK = """
WITH parts AS (
  SELECT page_id,
         lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(coalesce(url, ''), '^.*?://[^?#]*[?]([^#]*)', 1, 's') AS params
  FROM pages),
named AS (
  SELECT page_id, host, path,
         CASE WHEN host <> '' THEN regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/$', '')
           || CASE WHEN kept = '' THEN '' ELSE '?' || kept END END AS canonical
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(params, '&'),
          lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))), '&') AS kept
        FROM parts)),
listed AS (
  SELECT DISTINCT canonical FROM named JOIN labels ON page_id = doc_id
  WHERE (toxic = 1 OR quality = 0) AND canonical IS NOT NULL),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fitting AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM named JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT n.page_id, n.host, n.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM named n LEFT JOIN fitting f USING (page_id) LEFT JOIN listed l ON n.canonical = l.canonical
"""


@query("op9_url_filter", CHECK)
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page; listed are the addresses of pages labelled toxic or of low quality."""
    pages = table(spark, folder, "pages")
    marks = table(spark, folder, "labels").where("toxic = 1 or quality = 0").select("doc_id")
    listed = pages.join(marks, pages.page_id == marks.doc_id, "left_semi").select(
        canonical_url(F.col("url")).alias("canonical")
    )
    return judge_urls(pages, listed, RULES)
