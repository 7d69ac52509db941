"""The lexical columns of an index: terms, tokens and length per passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import (
    ascii_spaced,
    han_terms,
    index_tokens,
    latin_terms,
    locale_sorted,
    nfkc,
    rest_spaced,
)


def with_terms(rows: DataFrame, texts: dict[str, Column], ordered: bool = True) -> DataFrame:
    """Add a column of index terms per text, in locale order unless that is not needed.

    Each step is a projection of its own, because later steps use the earlier
    ones more than once and would otherwise compute them again.
    """
    clean = {f"_clean_{name}": nfkc(value) for name, value in texts.items()}
    plain = {f"_plain_{name}": ascii_spaced(F.col(f"_clean_{name}")) for name in texts}
    spaced = {f"_spaced_{name}": rest_spaced(F.col(f"_plain_{name}")) for name in texts}
    terms = {
        name: F.array_union(latin_terms(F.col(f"_spaced_{name}")), han_terms(F.col(f"_clean_{name}")))
        for name in texts
    }
    if ordered:
        terms = {name: locale_sorted(found) for name, found in terms.items()}
    stepped = rows.withColumns(clean).withColumns(plain).withColumns(spaced).withColumns(terms)
    return stepped.drop(*clean, *plain, *spaced)


def _titled() -> dict[str, Column]:
    return {"heading_terms": F.array_join("heading", " "), "content_terms": F.col("content")}


def with_lexical_columns(chunks: DataFrame) -> DataFrame:
    """Add the stored term lists and token sequences of heading and content."""
    rows = with_chunk_terms(chunks)
    return (
        rows.withColumn("heading_tokens", index_tokens(F.col("heading_terms")))
        .withColumn("content_tokens", index_tokens(F.col("content_terms")))
        .withColumn("doc_len", F.size("heading_tokens") + F.size("content_tokens"))
    )


def with_chunk_terms(chunks: DataFrame) -> DataFrame:
    """Add the stored term lists of heading and content."""
    return with_terms(chunks, _titled())
