"""Term sets of whole texts inside tasks, equal to those of ``functions.text``.

Where only the set of a text's terms is wanted, its words can first be made different, and
few of them have capitals or joining signs. The expressions take all words apart. What belongs
to terms, its lower case and its tokens come from a table that the expressions themselves make
of every character; no term holds white space, so words can be taken by themselves.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import HAN, LATIN_CLASS, TOKEN_CLASS, WHOLE_RUN_LIMIT, fold

_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_JOINING = str.maketrans("_./:-", "     ")


class Letters(NamedTuple):
    """By code point: letters of Latin terms, their lower case, what they give to tokens; Han ranges."""

    lower: dict[int, str]
    tokens: dict[int, str]
    han: str


def letters(spark: SparkSession) -> Letters:
    """The table of all characters that terms are made of, some 100,000."""
    # Planes from 4 on have marks and private characters only.
    codes = spark.range(0x40000).where(~F.col("id").between(0xD800, 0xDFFF))
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    read = codes.select("id", char.alias("c"))
    read = read.withColumns({"latin": F.col("c").rlike(f"[{LATIN_CLASS}]"), "han": F.col("c").rlike(HAN)})
    read = read.where("latin or han").withColumn("low", F.when(F.col("latin"), F.lower("c")).otherwise(F.col("c")))
    tokens = F.regexp_replace(fold(F.col("low")), f"[^{TOKEN_CLASS}]", " ")
    found = read.select("id", "latin", "han", "low", tokens.alias("tokens")).toArrow().to_pylist()
    lower, parts, han = {}, {}, []
    for row in sorted(found, key=lambda row: row["id"]):
        if row["latin"]:
            lower[row["id"]] = row["low"]
        if len(row["low"]) == 1:
            parts[ord(row["low"])] = row["tokens"]
        else:  # a letter and its marks, which folding takes off
            parts.update((ord(c), "") for c in row["low"] if unicodedata.category(c) == "Mn")
        if row["han"]:
            if han and han[-1][1] == row["id"] - 1:
                han[-1][1] = row["id"]
            else:
                han.append([row["id"], row["id"]])
    return Letters(lower, parts, "".join(f"\\U{first:08X}-\\U{last:08X}" for first, last in han))


class _Spaced(dict):
    """For ``str.translate``: what is not in it becomes a space."""

    def __missing__(self, code: int) -> str:
        return " "


class TermCounter:
    """How many tokens the terms of a text have, and how many are of each asked one."""

    def __init__(self, known: Letters, asked: list[str]):
        self._kept = _Spaced((code, chr(code)) for code in known.lower)
        self._lower, self._tokens = known.lower, known.tokens
        self._han = re.compile(f"[{known.han}]+")
        self._codes = {token: code for code, token in enumerate(asked)}

    def _latin(self, text: str) -> set[str]:
        spaced = text.translate(self._kept)
        raw = set(spaced.split(" "))
        mixed = raw.difference(spaced.translate(self._lower).split(" "))
        plain = raw - mixed
        terms = set(" ".join(plain).translate(_JOINING).split(" "))
        terms.update([word.strip("./:-") for word in plain - terms])
        mixed = " ".join(mixed)
        terms.update([word.strip("./:-") for word in mixed.translate(self._lower).split(" ")])
        terms.update(_CAMEL.sub(r"\1 \2", mixed).translate(self._lower).translate(_JOINING).split(" "))
        terms.discard("")
        return terms

    def _runs(self, text: str) -> set[str]:
        found = set()
        for run in self._han.findall(text):
            if len(run) <= WHOLE_RUN_LIMIT:
                found.add(run)
            found.update([run[i : i + 2] for i in range(len(run) - 1)])
        return found

    def add(self, text: str, weight: int, hits: dict[int, int]) -> int:
        """Adds ``weight`` for each asked token to ``hits`` by code; the number of all tokens.

        ``text`` is in compatibility composition, as ``nfkc`` gives it.
        """
        parts = [text]
        if not text.isascii():  # Python is quick with texts of ASCII alone
            words = set(text.split())
            rest = [word for word in words if not word.isascii()]
            parts = [" ".join(words.difference(rest)), " ".join(rest)]
        size, known = 0, set()
        for part in parts:
            terms = self._latin(part)
            if not part.isascii():
                terms = (terms | self._runs(part)) - known
            known = terms
            tokens = " ".join(terms).translate(self._tokens).split()
            size += len(tokens)
            for token in filter(self._codes.__contains__, tokens):
                code = self._codes[token]
                hits[code] = hits.get(code, 0) + weight
        return size
