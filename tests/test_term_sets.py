"""Term sets made in tasks against the expressions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.functions import term_sets
from lodestone.functions.text import nfkc
from lodestone.operators import scanning
from lodestone.operators.lexicon import with_lexical_columns

ODD = "aZ9_./:- \t\n\x1c\x85 éÉßſİıÐǄŉΣςσЖ½²٣Ⅷ〇〡々漢字仮名かナ한글ﬀ́̇ͅ🙂𠀀𝐀"
WORDS = ["scale-out", "camelCase", "x1Y2zZ", "İstanbul-İ", "a.b:C", "--", "../x/", "漢字", "漢字仮名漢字仮名漢字", "Σας", "über", "ǄǅǆÅ"]


def _texts():
    dice = random.Random(9)
    made = ["".join(dice.choices(ODD, k=dice.randint(0, 14))) for _ in range(300)]
    made += [" ".join(dice.choices(WORDS + made[:40], k=dice.randint(1, 9))) for _ in range(100)]
    return [*made, "", " ", "x" * 200 + " " + "y-" * 100]


def test_counts_equal_those_of_the_expressions(spark):
    rows = [(n, text, []) for n, text in enumerate(_texts())]
    told = spark.createDataFrame(rows, "n int, content string, heading array<string>")
    read = with_lexical_columns(told).select(nfkc(F.col("content")).alias("clean"), "content_tokens").collect()
    asked = sorted({token for row in read for token in row.content_tokens})
    counter = term_sets.TermCounter(term_sets.letters(spark), asked)
    for row in read:
        hits = {}
        assert counter.add(row.clean, 3, hits) == len(row.content_tokens), row.clean
        assert {asked[code]: n for code, n in hits.items()} == {
            token: 3 * n for token, n in Counter(row.content_tokens).items()
        }, row.clean


def test_every_character_counts_as_in_the_expressions(spark):
    codes = [code for code in range(0x110000) if not 0xD800 <= code <= 0xDFFF and code != 0xFEFF]
    rows = [(" ".join(f"q{chr(code)}A" for code in codes[at : at + 64]),) for at in range(0, len(codes), 64)]
    told = spark.createDataFrame(rows, "content string").withColumn("heading", F.array().cast("array<string>"))
    read = with_lexical_columns(told).select(nfkc(F.col("content")).alias("clean"), "content_tokens").collect()
    counter = term_sets.TermCounter(term_sets.letters(spark), [])
    assert [counter.add(row.clean, 1, {}) for row in read] == [len(row.content_tokens) for row in read]


def test_known_hits_take_no_terms_from_expressions(spark, monkeypatch):
    monkeypatch.setattr(scanning, "with_lexical_columns", None)
    shape = "chunk_id bigint, display_path string, start_line int, heading array<string>, content string"
    rows = [(1, "a.md", 1, ["Cache"], "cache-line CACHE"), (2, "b.md", 1, None, "cache"), (3, "c.md", 1, [], None), (4, "d.md", 1, [None], "")]
    hits = scanning.count_asked(spark.createDataFrame(rows, shape), spark.createDataFrame([("cache",)], "token string"))
    assert (hits.count, hits.length) == (4, 5)
    assert [(r.chunk_id, r.hits) for r in hits.rows.orderBy("chunk_id").collect()] == [(1, [6]), (2, []), (3, []), (4, [])]
    assert [(r.code, r.df) for r in hits.df.collect()] == [(0, 1)]
