"""SentencePiece encoding with source offsets, and decoding.

The model file is read here: its normaliser (a compiled character map, a double
array trie whose values point into a pool of replacements), its pieces and
their scores. Encoding a text takes three steps.

1. **Normalise.** At every position the longest prefix that the map knows is
   replaced; a character that it does not know stays. Beside each normalised
   byte the place of its source byte is kept.
2. **Merge.** The text is cut in front of spaces that follow another character
   (no piece spans such a cut, which is checked when the model is read), and the
   best-scored neighbouring pieces are merged, the leftmost first. Segments
   that were seen before come from a bounded memory.
3. **Project.** Lengths of pieces add up to normalised offsets, and the
   alignment turns them into byte spans of the source.

Only BPE models without user-defined pieces are read; others raise ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.registry import query, table

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "
MODEL = "piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """The compiled character map: longest known prefix to its replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self._units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self._pool = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self._units)

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``source[at:]`` and its replacement."""
        units, found = self._units, None
        node = self._child(0)
        for n in range(at, len(source)):
            node ^= source[n]
            unit = units[node]
            if unit & 0x800000FF != source[n]:
                break
            node ^= self._child_of(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = n + 1 - at, self._pool[start : self._pool.index(b"\0", start)]
        return found

    def _child(self, node: int) -> int:
        return node ^ self._child_of(self._units[node])

    @staticmethod
    def _child_of(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class PieceModel:
    """A SentencePiece BPE model that encodes with spans and decodes."""

    def __init__(self, path: str, memory: int = 500_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        kinds = [p.type for p in proto.pieces]
        if proto.trainer_spec.model_type != 2 or USER_DEFINED in kinds:
            raise ValueError("only BPE models without user-defined pieces are read")
        if proto.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("white space must be escaped and stand before words")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self._dummy, self._squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = kinds
        self._ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self._rank = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self._bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unk, self.bos, self.eos = (kinds.index(UNKNOWN), *(self._named(n) for n in ("<s>", "</s>")))
        self._pairs = {pair for p in self._ids for pair in zip(p, p[1:], strict=False)}
        joined = {c for p in self._ids if len(p) > 1 for c in p}
        alone = re.escape("".join(c for c in map(chr, range(128)) if c not in joined))
        self._cut = None
        if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self._ids):
            # No piece spans a mark after another character, or holds a lone one beside others.
            self._cut = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|[{alone}]")
        self._memory: dict[str, tuple[bytes, bytes, str]] = {}
        self._limit = memory

    def _named(self, piece: str) -> int:
        return self.pieces.index(piece)

    # -- normalising

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normalised text and, for each of its bytes and its end, the source byte.

        Without a character map and white-space rules the alignment is plain
        counting (one source byte for each space mark); it is then left out.
        """
        if not text:
            return "", None
        if not self.map and not self._squeeze:
            return (SPACE if self._dummy else "") + text.replace(" ", SPACE), None
        source, out, places = text.encode(), bytearray(), []
        mark, at, spaced = SPACE.encode(), 0, self._squeeze

        def put(data: bytes, place: int) -> None:
            out.extend(data)
            places.extend([place] * len(data))

        parts: list[tuple[bytes, int]] = []
        while at < len(source):
            found = self.map.longest(source, at) if self.map else None
            lead = source[at]
            width = found[0] if found else 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            parts.append((found[1] if found else source[at : at + width], at))
            at += width
        if self._squeeze:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
        if self._dummy and parts:
            put(mark, parts[0][1])
            spaced = self._squeeze
        for data, place in parts:
            if self._squeeze and spaced:
                data = data.lstrip(b" ")
            if data:
                put(data.replace(b" ", mark), place)
                spaced = data.endswith(b" ")
        end = len(source)
        while self._squeeze and bytes(out).endswith(mark):
            end = places[-3]
            del out[-3:], places[-3:]
        return out.decode(), np.array([*places, end], np.int64)

    # -- merging

    def _merged(self, segment: str) -> list[str]:
        """Pieces of a segment: repeatedly the best pair, of equals the leftmost."""
        parts: list[str] = list(segment)
        if len(parts) > 40:
            return self._merged_long(parts)
        rank, worst = self._rank, math.inf
        ranks = [rank.get(a + b, worst) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == worst:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], worst)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], worst)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        rank, heap = self._rank, []
        for i in range(len(parts) - 1):
            pair = parts[i] + parts[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                grown = pair + parts[after[i]]
                if grown in rank:
                    heapq.heappush(heap, (rank[grown], i, grown))
            h = before[i]
            if h >= 0:
                grown = parts[h] + pair
                if grown in rank:
                    heapq.heappush(heap, (rank[grown], h, grown))
        return [p for p in parts if p]

    def _segment(self, segment: str) -> tuple[bytes, bytes, str]:
        """Ids and normalised byte lengths of the pieces, and the decoded segment."""
        ids, widths = [], []
        if not segment[1:].isalpha() and len(bits := self._bits(segment)) > 1:
            found = [self._memory.get(b) or self._segment(b) for b in bits]
            ids, widths, surfaces = zip(*found, strict=True)
            return self._remember(segment, (b"".join(ids), b"".join(widths), "".join(surfaces)))
        parts = self._merged(segment)
        whole = [*map(self._ids.get, parts)]
        if None not in whole:
            form = f"<{len(parts)}I"
            widths = [len(p.encode()) for p in parts]
            known = struct.pack(form, *whole), struct.pack(form, *widths), segment.replace(SPACE, " ")
            return self._remember(segment, known)
        for part, found in zip(parts, whole, strict=True):
            data = part.encode("utf-8", "surrogatepass")
            if found is not None:
                ids.append(found)
                widths.append(len(data))
            elif self._bytes:
                # All bytes of a character span it; its last byte closes it.
                ids += [self._bytes[b] for b in data]
                widths += [0] * (len(data) - 1) + [len(data)]
            else:
                ids.append(self.unk)
                widths.append(len(data))
        form = f"<{len(ids)}I"
        known = struct.pack(form, *ids), struct.pack(form, *widths), self.surface(ids)
        return self._remember(segment, known)

    def _remember(self, segment: str, known: tuple[bytes, bytes, str]) -> tuple[bytes, bytes, str]:
        if len(self._memory) >= self._limit:
            self._memory.clear()
        if len(segment) <= 64:
            self._memory[segment] = known
        return known

    def _bits(self, segment: str) -> list[str]:
        """The segment cut between characters that stand together in no piece."""
        out, start = [], 0
        for i, pair in enumerate(zip(segment, segment[1:], strict=False), 1):
            if pair not in self._pairs:
                out.append(segment[start:i])
                start = i
        return [*out, segment[start:]]

    def _segments(self, text: str) -> list[str]:
        return self._cut.findall(text) if self._cut else [text] * bool(text)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, str]:
        """Ids without begin and end, (n, 2) byte spans of the source, decoded text."""
        normal, places = self.normalise(text or "")
        known = self._memory.get
        found = [known(s) or self._segment(s) for s in self._segments(normal)]
        all_ids, all_widths, surfaces = zip(*found, strict=True) if found else ((), (), ())
        ids = np.frombuffer(b"".join(all_ids), "<u4")
        widths = np.frombuffer(b"".join(all_widths), "<u4").astype(np.int64)
        decoded = "".join(surfaces)
        if self._dummy and decoded.startswith(" ") and len(ids) and self.pieces[ids[0]][:1] == SPACE:
            decoded = decoded[1:]
        ends = np.cumsum(widths)
        if places is None:
            places = self._counted(text or "")
        # A byte piece before the last of its character ends where the character begins.
        spans = np.stack([places[ends - widths], places[ends]], axis=1) if len(ids) else np.zeros((0, 2), np.int64)
        return ids, spans, decoded

    def _counted(self, text: str) -> np.ndarray:
        """Alignment of a text whose spaces become marks, after a mark for none."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        widths = np.where(data == 32, len(SPACE.encode()), 1)
        dummy = np.zeros(len(SPACE.encode()) * self._dummy, np.int64)
        return np.concatenate([dummy, np.repeat(np.arange(len(data)), widths), [len(data)]])

    # -- decoding

    def surface(self, ids) -> str:
        """Text of pieces in a row, spaces in place of marks, bytes put together."""
        out, run = [], bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                run.append(int(self.pieces[i][1:-1], 16))
                continue
            if run:
                out.append(_decoded_bytes(run))
                run = bytearray()
            if self.kinds[i] == UNKNOWN:
                out.append(UNKNOWN_SURFACE)
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_decoded_bytes(run))
        return "".join(out)

    def decode(self, ids) -> str:
        """Text of ids; the mark in front of the first piece is not a space."""
        plain = [i for i in ids if self.kinds[i] != CONTROL]
        text = self.surface(plain)
        marked = plain and self.pieces[plain[0]].startswith(SPACE)
        return text[1:] if marked and (self._dummy or self._squeeze) else text


def _decoded_bytes(data: bytearray) -> str:
    """UTF-8, with one replacement character for each byte that is no part of it."""
    try:
        return bytes(data).decode()
    except UnicodeDecodeError as e:
        good = bytes(data[: e.start]).decode()
        return good + "�" + _decoded_bytes(data[e.start + 1 :])


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, starts, ends, decoded``: ids with begin and end, byte spans of pieces.

    Begin and end have empty spans at the ends of the text. Null texts are empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(path or model_path())
        for rows in batches:
            out = []
            for text in rows["text"].tolist():
                ids, spans, decoded = model.encode(text)
                end = len((text or "").encode("utf-8", "surrogatepass"))
                spans = np.concatenate([[[0, 0]], spans, [[end, end]]])
                out.append(([model.bos, *ids.tolist(), model.eos], spans[:, 0], spans[:, 1], decoded))
            frame = pd.DataFrame(out, columns=["ids", "starts", "ends", "decoded"])
            frame.insert(0, "doc_id", rows["doc_id"].astype("Int64"))
            yield frame

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string"
    )


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What :func:`encode_pieces` finds, as counts and digests made in the same task.

    ``spans_sha256`` digests start and end of every piece as little-endian
    unsigned 64-bit integers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(path or model_path())
        first, last = (np.array([i], "<u4").tobytes() for i in (model.bos, model.eos))
        for rows in batches:
            out = []
            for text in rows["text"].tolist():
                ids, spans, decoded = model.encode(text)
                out.append(
                    (
                        len(ids) + 2,
                        hashlib.sha256(first + ids.tobytes() + last).hexdigest(),
                        hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(),
                        hashlib.sha256(spans.astype("<u8").tobytes()).hexdigest(),
                    )
                )
            frame = pd.DataFrame(
                out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
            )
            frame.insert(0, "doc_id", rows["doc_id"].astype("Int64"))
            yield frame

    return docs.select("doc_id", "text").mapInPandas(
        run,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string",
    )


@query("op1_piece_coding")
def op1_piece_coding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded with begin and end, then decoded."""
    return piece_digests(table(spark, folder, "documents"))
