import duckdb
import pytest

from lodestone.llm import url_rules as ur
from lodestone.llm.registry import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


def _brute(url):
    """Host, path and rule, spelt out."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fitting = [
        r for r in ur.RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fitting, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


URLS = [
    "https://Example.ORG/es/1", "https://a.example.org/en/17?x", "http://notexample.org/es/",
    "http://x.com/fr/", "http://x.com/de/?q", "http://com/de/9", "x.com/de/", None, "", "://", "a://b",
    "http://h?x=/de/", "http://h#://y/z", "http://É.com/fr/é", "http://a.org", "http://a.org/",
    "ftp://u@x.com:80/de/\nnew", "http://net/x://y/de/",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    listed = spark.createDataFrame([], "canonical string")
    got = {r["page_id"]: r for r in ur.judge_urls(pages, listed, ur.RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = _brute(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == (verdict or "allow")


@pytest.mark.parametrize("max_blocks", [1, 64])
def test_false_positives_are_removed(spark, max_blocks):
    """A filter of one block passes nearly everything; the answer stays exact."""
    rows = [(i, f"http://www.h{i % 400}.net/p/?utm_x=1&b=2&a=1#f") for i in range(1000)]
    rows += [(1000 + i, "http://hot.net/") for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, block string, w0 string".split(", block")[0])
    listed = [(f"h{i}.net/p?a=1&b=2",) for i in range(0, 400, 2)] + [("hot.net",), ("hot.net",), (None,)]
    listed = spark.createDataFrame(listed, "canonical string")
    got = ur.judge_urls(pages, listed, (), max_blocks).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = r["page_id"] >= 1000 or r["page_id"] % 400 % 2 == 0
        assert (r["verdict"] == "block") == expected and r["rule"] is None


def test_every_key_is_in_its_filter(spark):
    keys = spark.range(3000).selectExpr("concat('u', id) as canonical")
    blocks = ur.bloom_blocks(keys, "canonical", 16)
    assert blocks.count() == 16
    masks = [m.alias(f"m{j}") for j, m in enumerate(ur._masks(keys.canonical))]
    probed = keys.select(ur._block(keys.canonical, 16).alias("block"), *masks).join(blocks, "block")
    assert probed.where(" and ".join(f"(w{j} & m{j}) = m{j}" for j in range(8))).count() == 3000


def test_odd_tables(spark):
    pages = spark.createDataFrame(
        [(None, None, "x", 1), (1, "http://a.net/", "y", 2), (1, "http://a.net/", "y", 2)],
        "page_id long, url string, canonical string, block int",
    )
    listed = spark.createDataFrame([("a.net",)], "canonical string")
    got = sorted((r["page_id"] or 0, r["verdict"]) for r in ur.judge_urls(pages, listed, ur.RULES).collect())
    assert got == [(0, "allow"), (1, "block"), (1, "block")]
    assert ur.judge_urls(pages.limit(0), listed, ur.RULES).count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op9_url_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_query_equals_its_check(spark):
    got = QUERIES["op9_url_filter"](spark, FOLDER).toPandas()
    tables = duckdb.connect()
    for name in ("pages", "labels"):
        tables.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    expected = tables.execute(CHECKS["op9_url_filter"]).df()
    key = list(expected.columns)
    rows = [
        sorted(map(tuple, f[key].astype(object).where(f[key].notna(), "-").to_numpy().tolist()), key=str)
        for f in (got, expected)
    ]
    assert rows[0] == rows[1]
