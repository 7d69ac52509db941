"""Secrets in texts and in whatever is encoded in them.

Three kinds of secrets are exact patterns (``BASE_KINDS``). A worklist starts with the
text. A layer that is taken from it is scanned with the same patterns, and everything
encoded in it is decoded to new layers: percent-escapes of addresses, Unicode and
backslash escapes and numeric entities, runs of base64 (either alphabet, also broken
into lines), and in decoded bytes gzip, zlib, zstd, bzip2 and xz data. A layer that
was seen at the same place is not taken again, so the list runs dry: at the
fixpoint nothing decodes to anything new.

Bytes are kept as characters below 256, one each; all patterns are ASCII, so UTF-8
needs no decoding to be scanned. Each layer knows which characters of its parent
an own character came from, so a match is mapped back through all layers to a span of
code points of the text. Compressed data maps to its whole run.

Spans of decoded layers are of kinds ``decoded_…``; base spans always stay. A
secret that lies in the text as it is, beside something decoded, is reported once.

Null texts are empty. Decompression stops at ``MOST_BYTES`` of one layer, so that a
small text cannot fill a task's memory; what is unpacked by then is scanned, and
``n_cut`` counts such layers of a text. Decoding other than decompression
shrinks, so long texts need no limit.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.registry import query, table

BASE_KINDS = ("assign", "access", "hex")
DECODED = "decoded_"
MOST_BYTES = 64 << 20

# -- the base patterns (fixed values); a run of hex digits matches whole or not at all
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_VALUE, _KEY = 8, 16

_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(
    r"(?<!\\)\\++(?:u(?:005[cC]u)*([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})"
    r"|([\"'/nrtbf]))|&(?:amp;)*#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));"
)
_NAMED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_RUN = 16
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
_BROKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}[\x20\t]*\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]+")
_INSIDE = re.compile(r"[A-Za-z0-9+/_-]+")
_TO_STANDARD = str.maketrans("-_", "+/")
_PRINTABLE = bytes([*range(32, 127), 9, 10, 13])
_PLAUSIBLE = 0.85
_MAGIC = (b"\x1f\x8b", b"\x28\xb5\x2f\xfd", b"BZh", b"\xfd7zXZ\x00")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Exact patterns, sorted by start and then kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= _KEY]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


class Layer(NamedTuple):
    """A text, how it was decoded, and the way from its spans to the whole text's."""

    text: str
    names: tuple[str, ...]
    origin: Callable[[int, int], tuple[int, int]]
    cut: bool = False


def _same(start: int, end: int) -> tuple[int, int]:
    return start, end


def _character(m: re.Match) -> str:
    if m.re is _PERCENT:
        return chr(int(m[1], 16))
    if m[5]:
        return _NAMED.get(m[5], m[5])
    number = int(m[7]) if m[7] else int(m[1] or m[2] or m[3] or m[4] or m[6], 16)
    return chr(number) if number < 0x110000 else "�"


def _unescaped(layer: Layer, pattern: re.Pattern, name: str) -> Iterator[Layer]:
    """Each line that holds escapes, with all of them replaced.

    No pattern reaches over the end of a line, so other lines need no second look.
    """
    text, end = layer.text, 0
    found = pattern.search(text)
    while found:
        start = text.rfind("\n", 0, found.start()) + 1
        end = text.find("\n", found.end())
        end = len(text) if end < 0 else end
        parts, places, widths, at, length = [], [], [], start, 0
        for m in pattern.finditer(text, start, end):
            parts += [text[at : m.start()], _character(m)]
            length += m.start() - at
            places.append(length)
            widths.append(m.end())
            length += 1
            at = m.end()
        parts.append(text[at:end])

        def origin(s: int, e: int, places=places, widths=widths, start=start) -> tuple[int, int]:
            def begins(i: int) -> int:
                n = bisect_left(places, i)  # escapes in front of this character
                return start + i if n == 0 else widths[n - 1] + i - places[n - 1] - 1

            n = bisect_right(places, e - 1)  # escapes up to the last character
            last = start + e if n == 0 else widths[n - 1] + e - 1 - places[n - 1]
            return layer.origin(begins(s), last)

        yield Layer("".join(parts), (*layer.names, name), origin)
        found = pattern.search(text, end)


def _plausible(data: bytes) -> bool:
    if data.startswith(_MAGIC) or _zlib_header(data):
        return True
    odd = len(data.translate(None, _PRINTABLE))
    return odd <= (1 - _PLAUSIBLE) * len(data) or _wide(data)


def _wide(data: bytes) -> bool:
    """Text of two bytes a character."""
    return data.count(0) * 3 >= len(data) > 0


def _zlib_header(data: bytes) -> bool:
    return len(data) > 2 and data[0] & 0x8F == 0x08 and data[0] >> 4 <= 7 and (data[0] * 256 + data[1]) % 31 == 0


def _decoded64(run: str) -> tuple[int, bytes]:
    """The first of four alignments that gives text or compressed data, else the first."""
    run = run.translate(_TO_STANDARD)
    first = b""
    for shift in range(4):
        part = run[shift:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        if _plausible(data):
            return shift, data
        first = first or data
    return 0, first


def _base64_layers(layer: Layer, most: int) -> Iterator[Layer]:
    text = layer.text
    if not any(len(word) >= _RUN for word in text.split()):
        return
    runs = [(m.start(), m[0], None) for m in _BASE64.finditer(text)]
    for m in _BROKEN.finditer(text):
        inside = list(_INSIDE.finditer(m[0]))
        places = [m.start() + i for part in inside for i in range(*part.span())]
        runs.append((m.start(), "".join(part[0] for part in inside), places))
    for start, run, places in runs:
        shift, data = _decoded64(run)

        def origin(s: int, e: int, start=start, shift=shift, places=places) -> tuple[int, int]:
            first, last = shift + 8 * s // 6, shift + (8 * e - 1) // 6
            if places is None:
                return layer.origin(start + first, start + last + 1)
            return layer.origin(places[first], places[last] + 1)

        yield from _of_bytes(data, Layer("", (*layer.names, "base64"), origin), most)


def _inflated(data: bytes, most: int) -> tuple[str, bytes, bool] | None:
    """Name, bytes (at most ``most``) and whether they were cut, of compressed data."""
    try:
        if data.startswith(b"\x1f\x8b") or _zlib_header(data):
            name = "gzip" if data[:1] == b"\x1f" else "zlib"
            opened = zlib.decompressobj(47)
            return name, opened.decompress(data, most), bool(opened.unconsumed_tail)
        if data.startswith(_MAGIC[1]):
            out = zstandard.ZstdDecompressor().stream_reader(data).read(most)
            return "zstd", out, len(out) == most
        if data.startswith(b"BZh"):
            opened = bz2.BZ2Decompressor()
            out = opened.decompress(data, most)
            return "bzip2", out, not opened.eof and not opened.needs_input
        if data.startswith(_MAGIC[3]):
            opened = lzma.LZMADecompressor()
            out = opened.decompress(data, most)
            return "xz", out, not opened.eof and not opened.needs_input
    except (zlib.error, zstandard.ZstdError, OSError, lzma.LZMAError, ValueError, EOFError):
        pass
    return None


def _of_bytes(data: bytes, frame: Layer, most: int) -> Iterator[Layer]:
    """The layers of decoded bytes: as they are, without zeros, and unpacked."""
    names, cut = frame.names, frame.cut
    if _wide(data):
        kept = [i for i, x in enumerate(data) if x]
        if kept:

            def origin(s: int, e: int) -> tuple[int, int]:
                return frame.origin(kept[s], kept[e - 1] + 1)

            narrow = data.replace(b"\x00", b"").decode("latin-1")
            yield Layer(narrow, (*names, "utf-16"), origin, cut)
    yield Layer(data.decode("latin-1"), names, frame.origin, cut)
    unpacked = _inflated(data, most)
    if unpacked and unpacked[1]:
        name, out, short = unpacked

        def whole(s: int, e: int) -> tuple[int, int]:
            return frame.origin(0, len(data))

        yield Layer(out.decode("latin-1"), (*names, name), whole, short)


def _unfolded(layer: Layer, most: int) -> Iterator[Layer]:
    """Everything one step of decoding makes of a layer."""
    text = layer.text
    if "%" in text:
        yield from _unescaped(layer, _PERCENT, "url")
    if "\\" in text or "&" in text:
        yield from _unescaped(layer, _ESCAPE, "unicode")
    yield from _base64_layers(layer, most)
    if layer.names and layer.names[-1] in ("gzip", "zlib", "zstd", "bzip2", "xz"):
        # Packed twice: the bytes stand in the layer themselves.
        try:
            unpacked = _inflated(text.encode("latin-1"), most)
        except UnicodeEncodeError:
            unpacked = None
        if unpacked and unpacked[1]:
            name, out, short = unpacked

            def whole(s: int, e: int) -> tuple[int, int]:
                return layer.origin(0, len(text))

            yield Layer(out.decode("latin-1"), (*layer.names, name), whole, short)


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    layers: tuple[str, ...]


def _key(layer: Layer) -> tuple:
    digest = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return digest, layer.origin(0, max(1, len(layer.text)))


def scan(text: str | None, most: int = MOST_BYTES) -> tuple[list[Found], int]:
    """All secrets of a text and its layers, by start, and the number of cut layers."""
    text = text or ""
    base = base_spans(text)
    found = {(k, s, e): Found(k, s, e, ()) for k, s, e in base}
    work = deque(_unfolded(Layer(text, (), _same), most))
    seen, n_cut = set(), 0
    while work:
        layer = work.popleft()
        key = _key(layer)
        if not layer.text or key in seen:
            continue
        seen.add(key)
        n_cut += layer.cut
        for kind, s, e in base_spans(layer.text):
            start, end = layer.origin(s, e)
            if (kind, start, end) not in found:
                found.setdefault((DECODED + kind, start, end), Found(DECODED + kind, start, end, layer.names))
        work.extend(_unfolded(layer, most))
    kinds = (*BASE_KINDS, *(DECODED + k for k in BASE_KINDS))
    return sorted(found.values(), key=lambda f: (f.start, kinds.index(f.kind), f.end)), n_cut


def joined(found: list[Found] | list[Span]) -> str:
    return ",".join(f"{f[0]}:{f[1]}:{f[2]}" for f in found)


def find_secrets(docs: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``doc_id, secrets, n_cut`` of every text: spans with the layers they lay under."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows["text"].tolist():
                found, n_cut = scan(text, most)
                listed = [{"kind": f.kind, "start": f.start, "end": f.end, "layers": list(f.layers)} for f in found]
                out.append((listed, n_cut))
            made = pd.DataFrame(out, columns=["secrets", "n_cut"])
            made.insert(0, "doc_id", rows["doc_id"].astype("Int64"))
            yield made

    return docs.select("doc_id", "text").mapInPandas(
        run,
        "doc_id long, secrets array<struct<kind:string,start:long,end:long,layers:array<string>>>, n_cut long",
    )


def secret_digests(docs: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """What :func:`find_secrets` finds, as counts and digests made in the same task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows["text"].tolist():
                found, n_cut = scan(text, most)
                base = [f for f in found if not f.layers]
                count = Counter(f.kind for f in base)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((*(count[k] for k in BASE_KINDS), digest, joined(found), n_cut))
            columns = [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_cut"]
            made = pd.DataFrame(out, columns=columns)
            made.insert(0, "doc_id", rows["doc_id"].astype("Int64"))
            yield made

    return docs.select("doc_id", "text").mapInPandas(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cut long",
    )


@query("op13_secret_scan")
def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's secrets, in the text and in decoded layers."""
    return secret_digests(table(spark, folder, "documents"))
