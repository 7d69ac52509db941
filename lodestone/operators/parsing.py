"""Parsers by media type: each finds the sections of a text, and rows are routed in one pass.

A parser makes a column of sections from a column of texts (see ``chunking``). It sees the
texts of its own type only, so rows of several types need no split, union or shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.chunking import DEFAULT_MAX_CHARS, SECTION, chunk_documents, markdown_sections

Parser = Callable[[Column], Column]


def plain_sections(content: Column) -> Column:
    """One section without a heading, whose blocks are the lines between blank ones."""
    lines = F.split(content, "\r?\n", -1)
    blank = F.transform(lines, lambda line: F.trim(line) == "")
    numbers = F.sequence(F.lit(1), F.size(lines))

    def edge(step: int) -> Column:
        def here(n: Column) -> Column:
            return ~F.get(blank, n - 1) & F.coalesce(F.get(blank, n - 1 + step), F.lit(True))

        return F.filter(numbers, here)

    ranges = F.zip_with(
        edge(-1), edge(1), lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    )
    section = F.struct(
        F.array().cast("array<string>").alias("heading"),
        F.lit(0).alias("title_first"),
        F.lit(0).alias("title_last"),
        ranges.alias("ranges"),
    )
    none = F.array().cast(SECTION)
    return F.when(F.size(ranges) > 0, F.array(section).cast(SECTION)).when(content.isNotNull(), none)


PARSERS: dict[str, Parser] = {"text/markdown": markdown_sections, "text/plain": plain_sections}


def routed_sections(media_type: Column, content: Column, parsers: Mapping[str, Parser] = PARSERS) -> Column:
    """Each text's sections by the parser of its type; another type is an error."""
    chosen = F.when(media_type.isNull() | ~media_type.isin(*parsers), F.raise_error(
        F.concat(F.lit("PARSER_NOT_FOUND: "), F.coalesce(media_type, F.lit("no media type")))
    ).cast(SECTION))
    for name, parser in parsers.items():
        chosen = chosen.when(media_type == name, parser(F.when(media_type == name, content)))
    return chosen


def parse_documents(
    documents: DataFrame, max_chars: int = DEFAULT_MAX_CHARS, parsers: Mapping[str, Parser] = PARSERS
) -> DataFrame:
    """Chunks of documents of several types, from ``media_type`` and ``content``."""
    sections = routed_sections(F.col("media_type"), F.col("content"), parsers)
    return chunk_documents(documents, max_chars, sections=sections)
