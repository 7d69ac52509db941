"""Text expressions: normalisation, terms, index tokens, snippets, titles.

Everything here is a built-in expression over columns.  Arrays are made with
whole-text regular expressions instead of per-token lambdas, which keeps the
work in a handful of passes over each text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search meaning in a query.
STOP_WORDS = (
    "什么", "为什么", "怎么", "如何", "应该", "可以", "需要", "之后", "以后", "这个", "那个",
    "what", "where", "when", "why", "how", "does", "do", "are", "is", "the", "a", "an",
    "to", "of", "in", "for", "with", "be", "can",
)

# Cues that mark a query as a question.
CHINESE_CUES = (
    "什么", "为什么", "为何", "怎么", "怎样", "如何", "是否", "能否", "哪里", "哪儿", "多少",
    "应该", "怎么办", "吗",
)
ENGLISH_CUES = (
    "what", "where", "when", "why", "how", "does", "do", "are", "is", "should", "can",
    "could", "would",
)

# White space as ECMAScript's \s sees it; Java's \s is narrower.
SPACE = (
    r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
)
NON_ASCII = r"[^\x00-\x7F]"
HAN = r"\p{IsHan}"
TOKEN_CLASS = r"a-z0-9\p{L}\p{N}\p{Co}"
# Script lookups are slow, so the plain letters are tried first.
LATIN_CLASS = r"A-Za-z0-9_./:\-\p{IsLatin}\p{N}"
def _one_by_one(codes: Iterable[int]) -> str:
    """Members of a class by themselves: Java looks these up in one table, ranges one after another."""
    return "".join(f"\\x{code:02X}" for code in codes)


# ASCII without what LATIN_CLASS has, and what is neither ASCII nor a letter of Latin-1.
ASCII_SIGNS = f"[{_one_by_one(c for c in range(128) if not chr(c).isalnum() and chr(c) not in '_./:-')}]+"
BEYOND_LATIN_1 = f"[^{_one_by_one(c for c in range(256) if c < 128 or c >= 0xC0 and c not in (0xD7, 0xF7))}]"
# No Han character comes before this one.
MAYBE_HAN = r"[\u2E80-\uFFFF\x{10000}-\x{3FFFF}]"
WHOLE_RUN_LIMIT = 8
SNIPPET_CHARS = 240


def _none() -> Column:
    return F.array().cast("array<string>")


def nfkc(text: Column) -> Column:
    """Compatibility composition through the ICU library Spark ships."""
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)
    )
    return F.when(text.rlike(NON_ASCII), composed).otherwise(text)


def fold(text: Column) -> Column:
    """Lower case without diacritics, as the inverted index compares tokens."""
    parts = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.lower(text), F.lit(False)
    )
    bare = F.regexp_replace(parts, r"\p{Mn}+", "")
    return F.when(text.rlike(NON_ASCII), bare).otherwise(F.lower(text))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; only texts beyond the basic plane pay for it."""
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), units.cast("int")).otherwise(
        F.length(text)
    )


def term_text(text: Column) -> Column:
    """Only the runs of letters, digits and joining signs, one space apart."""
    return F.regexp_replace(text, f"[^{LATIN_CLASS}]+", " ")


def ascii_spaced(text: Column) -> Column:
    """ASCII signs that ``term_text`` leaves out, as spaces: the cheap part of its work."""
    return F.regexp_replace(text, ASCII_SIGNS, " ")


def rest_spaced(spaced: Column) -> Column:
    """``term_text`` of what ``ascii_spaced`` gave; most texts have only ASCII and Latin-1 letters left."""
    return F.when(spaced.rlike(BEYOND_LATIN_1), term_text(spaced)).otherwise(spaced)


def latin_terms(spaced: Column) -> Column:
    """Lower-cased identifiers plus their separator and camel-case parts."""
    ends = F.regexp_replace(F.lower(spaced), "[./:-]* [./:-]*", " ")
    whole = F.split(F.btrim(ends, F.lit("./:-")), " ")
    camel = F.regexp_replace(spaced, r"([a-z\d])([A-Z])", "$1 $2")
    parts = F.split(F.translate(F.lower(camel), "_./:-", "     "), " ")
    return F.array_remove(F.array_union(whole, parts), "")


def han_terms(text: Column) -> Column:
    """Short Han runs as they are, and the character pairs of every run."""
    runs = F.regexp_extract_all(text, F.lit(f"{HAN}+"), F.lit(0))
    short = F.filter(runs, lambda run: F.char_length(run) <= WHOLE_RUN_LIMIT)
    longer = F.filter(runs, lambda run: F.char_length(run) >= 2)
    pairs = F.flatten(
        F.transform(
            longer,
            lambda run: F.transform(
                F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2))
            ),
        )
    )
    return F.when(text.rlike(MAYBE_HAN), F.array_union(short, pairs)).otherwise(_none())


def term_set(text: Column) -> Column:
    """Distinct index terms, unordered."""
    clean = nfkc(text)
    return F.array_union(latin_terms(term_text(clean)), han_terms(clean))


def locale_sorted(terms: Column) -> Column:
    """Order strings by the root locale's collation instead of by bytes."""
    collated = terms.cast("array<string collate UNICODE>")
    return F.sort_array(collated).cast("array<string>")


def index_terms(text: Column) -> Column:
    """Distinct index terms in locale order: what the index stores per column."""
    return locale_sorted(term_set(text))


def search_terms(text: Column) -> Column:
    """Index terms that may be searched: no stop words, no single characters."""
    kept = F.array_except(index_terms(text), F.array(*[F.lit(word) for word in STOP_WORDS]))
    return F.filter(
        kept, lambda term: (utf16_length(term) >= 2) & ~term.rlike(f"^{HAN}$")
    )


def match_query(terms: Column) -> Column:
    """Quoted OR query over ``terms``; null when nothing is left to search."""
    quoted = F.transform(
        terms, lambda term: F.concat(F.lit('"'), F.replace(term, F.lit('"'), F.lit('""')), F.lit('"'))
    )
    return F.when(F.size(terms) > 0, F.array_join(quoted, " OR "))


def index_tokens(terms: Column) -> Column:
    """Token sequence of a stored term list.

    Stored terms are joined in order and cut at everything that is neither
    letter, number nor private-use, so ``scale-out`` gives two tokens.
    """
    return F.regexp_extract_all(
        fold(F.array_join(terms, " ")), F.lit(f"[{TOKEN_CLASS}]+"), F.lit(0)
    )


def clean_parts(parts: Column) -> Column:
    trimmed = F.transform(parts, js_trim)
    return F.filter(F.coalesce(trimmed, _none()), lambda part: part != "")


def query_mode(parts: Column) -> Column:
    """``terms`` for short navigation vocabulary, ``natural`` for the rest."""
    kept = clean_parts(parts)
    joined = F.array_join(kept, " ")
    english = r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(ENGLISH_CUES) + r")(?![A-Za-z0-9_])"
    question = joined.rlike("|".join(CHINESE_CUES)) | joined.rlike(english)
    compact = (utf16_length(joined) <= 32) & (F.size(F.split(joined, f"{SPACE}+")) <= 3)
    return (
        F.when(F.size(kept) == 0, "natural")
        .when(question, "natural")
        .when(F.size(kept).between(2, 5), "terms")
        .when((F.size(kept) == 1) & compact, "terms")
        .otherwise("natural")
    )


def snippet(content: Column, limit: int = SNIPPET_CHARS) -> Column:
    flat = js_trim(F.regexp_replace(content, f"{SPACE}+", " "))
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))
    return F.when(utf16_length(flat) <= limit, flat).otherwise(cut)


def plain_title(text: Column) -> Column:
    """Letters and digits only, for comparing titles with file names."""
    return F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]", "")


def display_heading(file_name: Column, heading: Column) -> Column:
    """Heading path without repeats and without a first part naming the file."""
    titles = F.transform(heading, plain_title)
    unique = F.filter(
        heading,
        lambda part, i: (i == 0) | (F.get(titles, i) != F.get(titles, i - 1)),
    )
    stem = plain_title(F.regexp_replace(file_name, r"\.[^.]+$", ""))
    first = F.get(unique, F.lit(0))
    names_file = (first != "") & F.endswith(plain_title(first), stem)
    rest = F.slice(unique, F.lit(2), F.greatest(F.size(unique) - 1, F.lit(0)))
    return F.when((F.size(unique) > 0) & names_file, rest).otherwise(unique)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")


def path_needle(path: Column) -> Column:
    """Comparable form of a path filter: slashes, no leading ``./``, lower case."""
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.lower(F.regexp_replace(slashes, r"^\./", ""))


def embedding_text(heading: Column, content: Column) -> Column:
    joined = F.array_join(heading, " > ")
    return F.when(joined != "", F.concat(joined, F.lit("\n\n"), content)).otherwise(content)


def mask_block(content: Column, start: str, end: str) -> Column:
    """Blank out the one region between two markers, keeping line breaks.

    Texts whose markers are missing, repeated or reversed stay as they are.
    """

    def occurrences(marker: str) -> Column:
        without = F.replace(content, F.lit(marker), F.lit(""))
        return (F.length(content) - F.length(without)) / len(marker)

    first = F.instr(content, start)
    last = F.instr(content, end)
    stop = last + len(end)
    inner = F.substring(content, first, stop - first)
    masked = F.concat(
        F.substring(content, F.lit(1), first - 1),
        F.regexp_replace(inner, r"[^\r\n]", " "),
        F.substring(content, stop, F.length(content)),
    )
    usable = (occurrences(start) == 1) & (occurrences(end) == 1) & (first < last)
    return F.when(usable, masked).otherwise(content)


def score_label(score: Column) -> Column:
    """Three decimals without the leading zero."""
    # format_number rounds the exact binary value; format_string does not.
    fixed = F.format_number(score, 3)
    return F.when(score < 1, F.regexp_replace(fixed, "^0", "")).otherwise(fixed)


def line_label(start_line: Column, end_line: Column) -> Column:
    whole = F.concat(F.lit("L"), start_line.cast("string"))
    return F.when(start_line == end_line, whole).otherwise(
        F.concat(whole, F.lit("-"), end_line.cast("string"))
    )
