from pyspark.sql import functions as F

from lodestone.functions import text


def evaluate(spark, value, function, kind="string"):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    return frame.select(function(F.col("v")).alias("r")).first().r


def test_identifiers_keep_their_whole_and_parts(spark):
    terms = evaluate(spark, "Parser read-only camelCase a_b 为什么需要 API 热更新", text.index_terms)
    assert {"parser", "read-only", "read", "only", "api", "热更", "更新", "热更新"} <= set(terms)
    assert {"camelcase", "camel", "case", "a_b", "a", "b"} <= set(terms)
    assert len(terms) == len(set(terms))


def test_compatibility_forms_and_locale_order(spark):
    assert evaluate(spark, "ＡＢ ﬁ", text.index_terms) == ["ab", "fi"]
    ordered = evaluate(spark, "b_1 é f e a-b ab", text.index_terms)
    assert ordered == ["1", "a", "a-b", "ab", "b", "b_1", "e", "é", "f"]


def test_punctuation_around_terms_is_trimmed(spark):
    assert evaluate(spark, "(foo.) :bar/ -- x.", text.index_terms) == ["bar", "foo", "x"]
    assert evaluate(spark, "", text.index_terms) == []


def test_long_han_runs_give_pairs_only(spark):
    terms = evaluate(spark, "一二三四五六七八九", text.index_terms)
    assert "一二三四五六七八九" not in terms and len(terms) == 8


def test_search_terms_drop_stop_words_and_single_characters(spark):
    terms = evaluate(spark, "What is 为什么 要 a x API 热更新", text.search_terms)
    assert {"api", "热更", "热更新", "更新"} <= set(terms)
    assert not {"what", "is", "为什么", "要", "a", "x"} & set(terms)


def test_match_query(spark):
    assert evaluate(spark, "API read-only", lambda c: text.match_query(text.search_terms(c))) == (
        '"api" OR "only" OR "read" OR "read-only"'
    )
    assert evaluate(spark, "... :: /-", lambda c: text.match_query(text.search_terms(c))) is None


def test_query_mode(spark):
    def mode(parts):
        return evaluate(spark, parts, text.query_mode, "array<string>")

    assert mode(["timeout", "重试", "队列"]) == "terms"
    assert mode(["限流"]) == "terms"
    assert mode(["warm cache"]) == "terms"
    assert mode(["怎么配置缓存"]) == "natural"
    assert mode(["Where", "is", "the cache"]) == "natural"
    assert mode(["this"]) == "terms"
    assert mode(None) == "natural"
    assert mode([" ", ""]) == "natural"
    assert mode(list("abcdef")) == "natural"
    assert mode(["one two three four"]) == "natural"
    assert mode(["x" * 33]) == "natural"


def test_snippet_and_mask(spark):
    assert evaluate(spark, "  a\n b  ", text.snippet) == "a b"
    long = evaluate(spark, "word " * 100, text.snippet)
    assert len(long) <= 240 and long.endswith("...")

    def mask(content):
        return evaluate(spark, content, lambda c: text.mask_block(c, "<s>", "</s>"))

    assert mask("a<s>b\r\nc</s>d") == "a    \r\n     d"
    assert mask("a<s>b") == "a<s>b"
    assert mask("</s>a<s>") == "</s>a<s>"
    assert mask("<s><s>a</s>") == "<s><s>a</s>"


def test_labels(spark):
    assert evaluate(spark, 0.2885, text.score_label, "double") == ".288"
    assert evaluate(spark, 1.0, text.score_label, "double") == "1.000"
    assert evaluate(spark, "./Docs\\A", text.path_needle) == "docs/a"


def test_utf16_length(spark):
    assert evaluate(spark, "a𠀀", text.utf16_length) == 3


def test_display_heading(spark):
    frame = spark.createDataFrame([(["Guide: setup", "Run", "run!", "End"],)], "h array<string>")
    shown = frame.select(text.display_heading(F.lit("Setup.md"), F.col("h")).alias("r")).first().r
    assert shown == ["Run", "End"]
