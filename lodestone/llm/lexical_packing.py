"""Lexical retrieval packing: windows filled with a seed document's neighbours.

Texts are shuffled once, to ranges of a lexical key, wherever they lay before: a
first pass counts the documents of each word (by bin), and the key of a text names
its rarest words that a few shards' documents have, that half a shard's have, and
that any other has. Texts of one key are split by a hash of their ids. In the order
of keys, shards are at most ``SHARD_DOCS`` documents (or ``SHARD_TOKENS``) of one
range; each has its own BM25 inverted index, and a seed sees its shard only.

A window starts with a seed: what is left of the last document, else the
first unused one. The unused documents that share words with the seed follow, best
first, then other unused ones. A document that does not fit is cut, and
its rest is the seed of the next window, so windows are full. A range's
last, partial window is cut into sequences whose lengths are powers of two.

Words are counted and keyed for many texts at once, in arrays of their bytes. To be packed,
texts are split at spaces: each different piece between these is encoded and cut into
words once, and the ids and words of a text are those of its pieces.

Numbers of sequences come from the number of the range, and rows are sorted in it, so a
task that is run again after a lost executor makes the same sequences.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.registry import query, table

WINDOW = 1024
SHARD_DOCS = 1024
SHARD_TOKENS = 2_000_000
#: Bins of words when their documents are counted; bin 0 is no word.
WORD_BINS = 1 << 20
#: Bins whose counts are sent together.
BLOCK = 1 << 10
#: A key names the rarest words of at least so many documents; the last level is in 12 bits.
LEVELS = (2 * SHARD_DOCS, SHARD_DOCS // 2, 2)
#: Characters of the texts that are taken apart together.
GROUP_CHARS = 1 << 18
#: The same for texts that are packed; each different piece of these is encoded once.
READ_CHARS = 1 << 22
RANGE_CHARS = 1 << 24
SAMPLED = 40
K1, B = 1.2, 0.75
FEW = 16
END_ID = 0
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


class ByteCoder:
    """Byte-level BPE ids of whole texts.

    Two libraries read the same vocabulary; the faster one encodes, and texts
    that hold a special token's string go to the other, which knows these.
    The tests compare both on every token and every character.
    """

    def __init__(self, path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        added = self._library.get_added_tokens_decoder().values()
        self._special = [t.content for t in added]
        with open(ranks_path, "rb") as f:
            pairs = [line.split() for line in f]
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in pairs}
        self._fast = tiktoken.Encoding(
            "byte-bpe",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens={},
        )
        self._spaced = np.zeros(max(ranks.values()) + 1, bool)
        self._spaced[[rank for piece, rank in ranks.items() if piece.startswith(b" ")]] = True

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self._special)

    def encode(self, text: str) -> np.ndarray:
        if self.has_special(text):
            ids = self._library.encode(text, add_special_tokens=False).ids
            return np.array(ids, np.uint32)
        return self._fast.encode_to_numpy(text, disallowed_special=())

    def encode_spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each follow a space, and where each word's begin.

        Words are not empty, hold no space, and no white space at their ends.
        No merge crosses such a space, so the tokens that begin with it are the words' first.
        """
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = self._fast.encode_to_numpy(" " + " ".join(words), disallowed_special=())
        return ids, np.flatnonzero(self._spaced[ids])


@lru_cache(maxsize=1)
def byte_coder(path: str | None, ranks_path: str | None) -> ByteCoder:
    import public_tokenizers

    return ByteCoder(
        path or public_tokenizers.path(VOCABULARY), ranks_path or public_tokenizers.path(RANKS)
    )


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    places = np.repeat(starts - ends + lengths, lengths)
    places += np.arange(len(places))
    return places


def groups(texts: list[str], chars: int) -> Iterator[slice]:
    """Consecutive texts of about ``chars`` characters together, one at least and under 2^15."""
    start, used = 0, 0
    for i, text in enumerate(texts):
        used += len(text) + (chars >> 14)
        if used >= chars:
            yield slice(start, i + 1)
            start, used = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


#: Words of more bytes are treated one by one.
LONG = 32


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place of ``data`` as a number."""
    return np.ndarray((len(data) - 7,), "<i8", data, 0, (1,))


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray]]:
    """For each eight bytes of words up to ``LONG``: their place, which words have them, how many of the eight."""
    yield 0, slice(None), np.minimum(lengths, 8)
    some = np.flatnonzero(lengths > 8)
    for at in range(8, LONG, 8):
        if not len(some):
            return
        left = lengths[some] - at
        yield at, some, np.minimum(left, 8)
        some = some[left > 8]


_LOW = np.array([(1 << 8 * i) - 1 for i in range(8)] + [-1], np.int64)
_HIGH = np.array([0] + [-1 << 64 - 8 * i for i in range(1, 9)], np.int64)


def _keys(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit keys of words in ``data``."""
    eights, keys = _eights(data), lengths.astype(np.uint64) * 0x9E3779B97F4A7C15
    for at, some, n in _blocks(lengths):
        mixed = (keys[some] ^ (eights[starts[some] + at] & _LOW[n]).view(np.uint64)) * 0x2545F4914F6CDD1D
        keys[some] = mixed ^ mixed >> 32
    keys *= 0xBF58476D1CE4E5B9
    keys = (keys ^ keys >> 29).view(np.int64)
    for i in np.flatnonzero(lengths > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : starts[i] + lengths[i]], digest_size=8).digest()
        keys[i] = int.from_bytes(digest, "little", signed=True)
    return keys


def _first_of_alike(keys: np.ndarray) -> np.ndarray:
    """For each key the place where it comes first; keys of the same low bits are taken for the same."""
    bits = len(keys).bit_length()
    ranked = np.sort(keys << bits | np.arange(len(keys)))  # faster than sorting places
    at = ranked & (1 << bits) - 1
    new = np.diff(ranked >> bits, prepend=~(ranked[:1] >> bits)) != 0
    first = np.empty_like(at)
    first[at] = at[new][np.cumsum(new) - 1]
    return first


def _one_of_alike(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each word in ``data`` one word of the same bytes; long words stand for themselves only."""
    one = _first_of_alike(_keys(data, starts, lengths))
    # Words of one key are compared.
    eights, same = _eights(data), (lengths == lengths[one]) & (lengths <= LONG)
    for at, some, n in _blocks(np.where(same, lengths, 0)):
        ours, theirs = eights[starts[some] + at], eights[starts[one[some]] + at]
        same[some] &= (ours ^ theirs) & _LOW[n] == 0
    return np.where(same, one, np.arange(len(one)))


#: White space as ``str.split`` knows it: of one byte, and of more.
_SPACE = bytes(i in (*range(9, 14), *range(28, 33)) for i in range(256))
_WIDE_STARTS = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_WIDE_SPACE = re.compile(
    b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words in ``data``, which begins and ends with a space, begin, and their lengths."""
    if not data.isascii() and any(s in data for s in _WIDE_STARTS):
        data = _WIDE_SPACE.sub(lambda m: b" " * len(m[0]), data)
    space = np.frombuffer(data.translate(_SPACE), bool)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    return edges[::2], edges[1::2] - edges[::2]


def _crc_lanes() -> np.ndarray:
    """What two bytes add to a CRC-32, by their distance in pairs from the word's end."""
    # The sum is linear but for a term of the length, so a byte's part follows from its distance.
    step = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))
    parts = [step]
    for _ in range(LONG - 1):
        parts.append(step[parts[-1] & 0xFF] ^ parts[-1] >> 8)
    return np.array([(near[:, None] ^ far[None, :]).ravel() for near, far in zip(parts[::2], parts[1::2], strict=True)])


_LANES = _crc_lanes()
_OF_ZEROS = np.array([zlib.crc32(bytes(i)) for i in range(LONG + 1)], np.uint32)


def crc32(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of words in ``data``, which has eight bytes in front of them."""
    eights, ends = _eights(data), starts + lengths
    sums = _OF_ZEROS[np.minimum(lengths, LONG)]
    for at, some, n in _blocks(lengths):
        last = eights[ends[some] - at - 8] & _HIGH[n]
        part = _LANES[at // 2 + 3][last & 0xFFFF]
        for lane in (1, 2, 3):
            part ^= _LANES[at // 2 + 3 - lane][last >> 16 * lane & 0xFFFF]
        sums[some] ^= part
    for i in np.flatnonzero(lengths > LONG).tolist():
        sums[i] = zlib.crc32(data[starts[i] : ends[i]])
    return sums


def read_texts(coder: ByteCoder, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text its ids with the end id, and the keys of its lower-cased words.

    What lies between two spaces is read once for all texts. Texts with an empty piece, a
    piece with white space at an end, or a special token's string are encoded as a whole.
    """
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join([*coded, bytes(8)])
    flat = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(flat == ord(" "))
    starts = np.concatenate([[0], ends[:-1] + 1])
    firsts = np.searchsorted(starts, np.cumsum([0, *(len(c) + 1 for c in coded[:-1])]))

    one = _one_of_alike(data, starts, ends - starts)
    alone = np.flatnonzero(one == np.arange(len(one)))
    numbers = np.empty(len(one), np.int64)
    numbers[alone] = np.arange(len(alone))
    numbers = numbers[one]
    joined = flat[_ranges(starts[alone], ends[alone] + 1 - starts[alone])].tobytes().decode("utf-8", "surrogatepass")
    keys, having, whole = _piece_words(joined)
    words = _by_text(keys, having, numbers, firsts)
    pieces = joined.split(" ")[:-1]
    values, begin = coder.encode_spaced([p for p, odd in zip(pieces, whole.tolist(), strict=True) if not odd])
    held = np.zeros(len(whole), np.int64)
    held[~whole] = np.diff(begin, append=len(values))
    ids = _by_text(values, held, numbers, firsts)
    whole = np.logical_or.reduceat(whole[numbers], firsts)
    end = np.array([END_ID], np.uint32)
    for i, text in enumerate(texts):
        if whole[i] or coder.has_special(text):
            ids[i] = np.concatenate([coder.encode(text), end])
        else:  # the first piece follows no space
            first = coder.encode(text[: len(text) if (at := text.find(" ")) < 0 else at])
            ids[i] = np.concatenate([first, ids[i][held[numbers[firsts[i]]] :], end])
    return ids, words


def _piece_words(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the lower-cased words of pieces, how many each piece has, and which pieces are odd.

    A space follows each piece. An odd one is empty or has white space at an end.
    """
    data = joined.lower().encode("utf-8", "surrogatepass")
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == ord(" ")) + 1
    data = b" " + data + b" " * 8
    starts, lengths = _words(data)
    until = np.searchsorted(starts, ends)
    held = np.diff(until, prepend=0)
    odd = held == 0
    some = np.flatnonzero(~odd)
    begin, last = np.concatenate([[1], ends[:-1] + 1])[some], until[some] - 1
    odd[some] = (starts[until[some] - held[some]] != begin) | (starts[last] + lengths[last] != ends[some])
    return _keys(data, starts, lengths), held, odd


def _by_text(values: np.ndarray, held: np.ndarray, numbers: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
    """The values of each text's pieces: a piece has ``held`` of ``values``, a text begins at one of ``firsts``."""
    lengths = held[numbers]
    values = values[_ranges((np.cumsum(held) - held)[numbers], lengths)]
    return np.split(values, np.cumsum(np.add.reduceat(lengths, firsts))[:-1])


def _in_order(keys: np.ndarray) -> np.ndarray:
    """Numbers of keys, from 0 in the order in which they come first."""
    first = _first_of_alike(keys)
    if (keys[first] != keys).any():
        _, first, numbers = np.unique(keys, return_index=True, return_inverse=True)
        first = first[numbers]
    return (np.cumsum(first == np.arange(len(keys))) - 1)[first]


class ShardIndex:
    """BM25 inverted index of a shard's texts: lower-cased words between white space.

    ``words`` are keys of the texts' words, where these are known.
    """

    def __init__(self, texts: list[str], words: list[np.ndarray] | None = None):
        if words is None:
            number = defaultdict(count().__next__).__getitem__
            words = [np.array([*map(number, t.lower().split())], np.int64) for t in texts]
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = _in_order(np.concatenate(words) if n else np.zeros(0, np.int64))
        pairs = np.sort(flat * n + np.repeat(np.arange(n), lengths))
        at = np.flatnonzero(np.diff(pairs, prepend=-1))
        tf = np.diff(at, append=len(pairs)).astype(np.float64)
        term, doc = np.divmod(pairs[at], max(1, n))
        df = np.bincount(term, minlength=1)
        # A word of one document leads to no other.
        shared = df[term] > 1
        term, self._doc, tf = term[shared], doc[shared], tf[shared]
        order = np.argsort(self._doc.astype(np.min_scalar_type(n)), kind="stable")
        own = np.bincount(self._doc, minlength=n)
        self._own = np.split(term[order], np.cumsum(own)[:-1])
        self._df = df
        self._ends = np.cumsum(np.where(df > 1, df, 0))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n else 1.0))
        self._term = term
        self._weight = idf[term] * tf * (K1 + 1) / (tf + norm[self._doc])
        self._n = self._held = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All unused documents that share words with the seed, best first."""
        return np.fromiter(self.best_first(seed, unused), np.int64)

    def best_first(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """The neighbours; those after the first few are put in order when asked for."""
        own = self._own[seed]
        if not len(own):
            return
        if 2 * np.count_nonzero(unused) < self._held:
            self._drop(unused)
        ends, df = self._ends[own], self._df[own]
        rows = _ranges(ends - df, df)
        scores = np.bincount(self._doc[rows], self._weight[rows], self._n)
        scores[seed] = 0
        found = np.flatnonzero((scores > 0) & unused)
        scores = -scores[found]
        if len(found) > FEW:
            few = scores <= np.partition(scores, FEW - 1)[FEW - 1]
            yield from found[few][np.argsort(scores[few], kind="stable")].tolist()
            found, scores = found[~few], scores[~few]
        yield from found[np.argsort(scores, kind="stable")].tolist()

    def _drop(self, unused: np.ndarray) -> None:
        """Leaves out postings of used documents; the others' scores stay."""
        kept = unused[self._doc]
        self._term, self._doc, self._weight = self._term[kept], self._doc[kept], self._weight[kept]
        self._df = np.bincount(self._term, minlength=len(self._df))
        self._ends = np.cumsum(self._df)
        self._held = np.count_nonzero(unused)


class Packer:
    """Fills the windows of one partition, shard after shard."""

    def __init__(self, partition: int, window: int = WINDOW):
        self._window = window
        self._base = partition << 40
        self._sequence = 0
        self._open: list[tuple] = []  # pieces of the window that is being filled
        self._used = 0

    def pack(
        self, names: list, ids: list[np.ndarray], texts: list[str], words: list[np.ndarray] | None = None
    ) -> Iterator[tuple]:
        index = ShardIndex(texts, words)
        unused = np.ones(len(ids), bool)
        following = 0
        waiting: Iterator[int] = iter(())
        while True:
            doc = next((d for d in waiting if unused[d]), None)
            seed = doc is None
            if seed:
                while following < len(ids) and not unused[following]:
                    following += 1
                if following == len(ids):
                    return
                doc = following
            unused[doc] = False
            crossed = yield from self._place(names[doc], ids[doc])
            if self._used == 0:
                waiting = iter(())  # the window is full, and nothing is left of its last document
            elif crossed or seed:
                waiting = index.best_first(doc, unused)

    def _place(self, name, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces of full windows; true if the document ends in another window."""
        at, crossed = 0, False
        while at < len(ids):
            take = min(len(ids) - at, self._window - self._used)
            self._open.append((name, at, ids[at : at + take], len(ids), self._used))
            self._used += take
            at += take
            if self._used == self._window:
                yield from self._close(self._open)
                self._open, self._used, crossed = [], 0, at < len(ids)
        return crossed

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        for name, start, ids, total, offset in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            yield name, start, len(ids), crc, total, self._base + self._sequence, offset
        self._sequence += 1

    def finish(self) -> Iterator[tuple]:
        """The open window as sequences whose lengths are powers of two."""
        pieces, left = self._open, self._used
        while left:
            size = 1 << (left.bit_length() - 1)
            room, part, rest = size, [], []
            for name, start, ids, total, _ in pieces:
                take = min(room, len(ids))
                if take:
                    part.append((name, start, ids[:take], total, size - room))
                if take < len(ids):
                    rest.append((name, start + take, ids[take:], total, 0))
                room -= take
            yield from self._close(part)
            pieces, left = rest, left - size
        self._open, self._used = [], 0


OUT = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def word_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the different lower-cased words of each text, and how many each text has.

    Words of one text are the same if their CRC-32 and their length (up to 65,535) are.
    """
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join([b" " * 8, *coded, b" " * 8])
    starts, lengths = _words(data)
    firsts = np.cumsum([9, *(len(c) + 1 for c in coded)])
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, firsts)))
    words = text << 48 | np.minimum(lengths, 0xFFFF) << 32 | crc32(data, starts, lengths)
    words.sort()
    words = words[np.diff(words, prepend=-1) != 0]
    return (words & 0xFFFFFFFF) % (WORD_BINS - 1) + 1, np.bincount(words >> 48, minlength=len(texts))


def word_documents(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """How many documents have the words of each bin; numbers of documents and characters."""
    size = WORD_BINS + BLOCK  # after the words the first counts characters; bin 0 documents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size, np.int64)
        for rows in batches:
            texts = [t or "" for t in rows["text"].tolist()]
            sums[0] += len(texts)
            sums[WORD_BINS] += sum(map(len, texts))
            for group in groups(texts, GROUP_CHARS):
                np.add.at(sums, word_bins(texts[group])[0], 1)
        blocks = sums.reshape(-1, BLOCK)
        found = np.flatnonzero(blocks.any(axis=1))
        yield pd.DataFrame({"block": found, "counts": [blocks[i].tobytes() for i in found.tolist()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size, np.int64)
        blocks = sums.reshape(-1, BLOCK)
        for rows in batches:
            for block, counts in zip(rows["block"].tolist(), rows["counts"].tolist(), strict=True):
                blocks[block] += np.frombuffer(counts, np.int64)
        found = np.flatnonzero(sums)
        yield pd.DataFrame({"bin": found, "n": sums[found]})

    # A row for each block: one for each bin would cost more than counting.
    dealt = docs.select("text").mapInPandas(run, "block long, counts binary").repartition("block")
    counted = dealt.mapInPandas(add, "bin long, n long")
    # No level asks for words of one document.
    wanted = (F.col("n") > 1) | F.col("bin").isin(0, WORD_BINS)
    # As Arrow columns: a row object of each bin would take hundreds of megabytes.
    rows = counted.where(wanted).toArrow()
    sums = np.zeros(size, np.int64)
    sums[rows["bin"].to_numpy()] = rows["n"].to_numpy()
    return sums[:WORD_BINS], int(sums[0]), int(sums[WORD_BINS])


def lexical_keys(texts: list[str], documents: np.ndarray) -> np.ndarray:
    """The bins of each text's rarest words of each level, in 52 bits."""
    bins, held = word_bins(texts)
    ranked = documents[bins] * WORD_BINS + bins
    some, most = held > 0, np.iinfo(np.int64).max
    levels = np.zeros((len(LEVELS), len(texts)), np.int64)
    if len(bins):
        firsts = (np.cumsum(held) - held)[some]
        for level, least in zip(levels, LEVELS, strict=True):
            found = np.minimum.reduceat(np.where(ranked >= least * WORD_BINS, ranked, most), firsts)
            level[some] = np.where(found == most, 0, found % WORD_BINS)
    first, second, third = levels
    return (first * WORD_BINS + second) << 12 | third & 0xFFF


def by_lexical_key(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """``doc_id, text``, dealt to ranges of the key of about ``range_chars`` and sorted in these.

    11 bits of a hash of the id follow the key, so that many texts of one key are split.
    """
    documents, rows, chars = word_documents(docs)
    documents = documents.astype(np.int64)
    ranges = max(1, -(-chars // range_chars))

    def places(bounds: np.ndarray):
        @F.pandas_udf("struct<key:long,place:int>")
        def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for column, salts in batches:
                texts = [t or "" for t in column.tolist()]
                keys = [np.zeros(0, np.int64), *(lexical_keys(texts[g], documents) for g in groups(texts, GROUP_CHARS))]
                key = np.concatenate(keys) << 11 | salts.to_numpy(np.int64)
                yield pd.DataFrame({"key": key, "place": np.searchsorted(bounds, key, "right").astype(np.int32)})

        return place("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 11)))

    bounds = np.zeros(0, np.int64)
    if ranges > 1:
        every = max(1, rows // (SAMPLED * ranges))
        some = docs.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(every)) == 0)
        keys = np.sort(some.select(places(bounds)["key"].alias("key")).toArrow()["key"].to_numpy())
        if len(keys):
            bounds = keys[np.arange(1, ranges) * len(keys) // ranges]
    placed = docs.select("doc_id", "text", places(bounds).alias("at"))
    dealt = placed.repartitionById(ranges, F.col("at.place"))
    return dealt.sortWithinPartitions("at.key", "doc_id", "text").select("doc_id", "text")


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    ranks_path: str | None = None,
    window: int = WINDOW,
    shard_docs: int = SHARD_DOCS,
    range_chars: int = RANGE_CHARS,
) -> DataFrame:
    """The pieces of all documents, each id in one piece.

    A document is its ids and one end id, so null and empty texts are that id
    alone. Repeated rows are packed each by itself. Other columns are left out.
    """
    columns = [c.split()[0] for c in OUT.split(", ")]

    def frame(rows: Iterator[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(list(rows), columns=columns)
        made["doc_id"] = made["doc_id"].astype("Int64")
        return made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = byte_coder(path, ranks_path)
        packer = None
        names, ids, words, tokens = [], [], [], 0
        for rows in batches:
            if packer is None:
                packer = Packer(int(rows["part"].iloc[0]), window)
            keys = [None if k is pd.NA else k for k in rows["doc_id"].astype("Int64").tolist()]
            texts = [t or "" for t in rows["text"].tolist()]
            for group in groups(texts, READ_CHARS):
                for more in zip(keys[group], *read_texts(coder, texts[group]), strict=True):
                    for kept, one in zip((names, ids, words), more, strict=True):
                        kept.append(one)
                    tokens += len(ids[-1])
                    if len(ids) >= shard_docs or tokens >= SHARD_TOKENS:
                        yield frame(packer.pack(names, ids, [], words))
                        names, ids, words, tokens = [], [], [], 0
        if packer is not None:
            yield frame(packer.pack(names, ids, [], words))
            yield frame(packer.finish())

    docs = by_lexical_key(docs.select("doc_id", "text"), range_chars)
    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInPandas(run, OUT)


@query("op2_retrieval_packing")
def op2_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into sequences of 1024 ids."""
    return pack_documents(table(spark, folder, "documents"))
