"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word is two inputs: an embedding of its hash, and the mean of embeddings of
the hashes of its character n-grams, so forms of a word are known by their
parts. A run of over ``LONGEST`` characters without white space, as in Chinese or
Thai, is several words. Two gated recurrent units read a window of words in both directions,
attention pools their states, and a logistic unit scores the window. A text is
scored over all its overlapping windows and has the score of the highest.

The network is trained in numpy on the driver, on a bounded sample of labelled
documents (``SAMPLE``, half of each label). Labels are of documents, so training
takes of each document the window that the network scores highest; to begin with,
embeddings carry the log odds of their words and n-grams, and the first windows
of toxic documents are those of the highest odds. Scoring runs in tasks; a word's share of the gates'
inputs is worked out once and kept in a bounded memory.

Texts without words, null ones too, score 0. A column ``score`` of the input is
replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.registry import query, table
from lodestone.llm.samples import held_out, labelled_sample

SAMPLE = 6000
#: What is kept of a sampled document for training: this many windows, of the highest odds.
SAMPLE_WINDOWS = 12
#: Bins of words when odds are counted over whole sampled texts.
ODDS_BINS = 1 << 18
WINDOW, STRIDE = 64, 48
#: A longer run without white space counts as several words.
LONGEST = 64
WORD_BINS, GRAM_BINS = 1 << 13, 1 << 14
WORD_WIDTH, GRAM_WIDTH, HIDDEN = 8, 16, 8
GRAMS = range(3, 6)
REJECT = 0.3
DROPOUT, DECAY = 0.15, 0.02
CALIBRATE = 6
#: Words and n-grams of fewer documents of the sample say nothing.
MIN_DOCUMENTS = 3
SEED = 11

_EDGE = ".,;:!?\"'()[]{}<>*#$%&|=+-_/\\~`^@"
_ODD = np.uint32(0x9E3779B1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, -30, 30)))


def words_of(text: str | None) -> list[str]:
    """Runs between white space; a long one is cut into consecutive words, all of it kept."""
    words = (text or "").lower().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words; bins of all their character n-grams; how many each word has."""
    plain = [("<" + (w.strip(_EDGE) or w[:1]) + ">").encode("utf-8", "surrogatepass") for w in words]
    hashes = np.array([zlib.crc32(w) for w in plain], np.int64)
    lengths = np.array([len(w) for w in plain], np.int64)
    codes = np.frombuffer(b"".join(plain), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), lengths)
    grams, owners = [], []
    rolled = np.zeros(len(codes), np.uint32)
    for n in range(1, GRAMS.stop):
        if len(codes) < n:
            break
        rolled = (rolled[: len(codes) - n + 1] * _ODD) ^ (codes[n - 1 :] + np.uint32(257))
        if n in GRAMS:
            inside = owner[: len(rolled)] == owner[n - 1 :]
            mixed = rolled[inside] * _ODD
            grams.append((mixed ^ (mixed >> np.uint32(15))).astype(np.int64) % GRAM_BINS)
            owners.append(owner[: len(rolled)][inside])
    if not grams:
        return hashes, np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    gram, of = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return hashes, gram[order], np.bincount(of, minlength=len(words))


def window_starts(words: int) -> range:
    """Starts of the overlapping windows that cover all words; at least one."""
    return range(0, max(1, words - (WINDOW - STRIDE)), STRIDE)


class Network:
    """Parameters, forward pass, and training by Adam."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        h, x = HIDDEN, WORD_WIDTH + GRAM_WIDTH

        def normal(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": normal(WORD_BINS, WORD_WIDTH, scale=0.1),
            "gram": normal(GRAM_BINS, GRAM_WIDTH, scale=0.1),
            "w_in": normal(x, 6 * h, scale=x**-0.5),
            "b_in": np.zeros(6 * h, np.float32),
            "u_f": normal(h, 3 * h, scale=h**-0.5),
            "u_b": normal(h, 3 * h, scale=h**-0.5),
            "attend": normal(2 * h, scale=0.3),
            "out": normal(2 * h, scale=0.3),
            "bias": np.zeros(1, np.float32),
        }
        #: Hashes of the words that have an embedding; others have their n-grams only.
        self.known = np.zeros(0, np.int64)
        #: A document's score is the logistic of slope * logit + offset.
        self.slope, self.offset = 1.0, 0.0

    # -- forward

    def word_vectors(self, inputs: tuple) -> tuple[np.ndarray, tuple]:
        """Vectors of the words of :func:`word_inputs`."""
        hashes, grams, counts = inputs
        known = np.isin(hashes, self.known)
        sums = np.zeros((len(hashes), GRAM_WIDTH), np.float32)
        has = np.flatnonzero(counts)
        ends = np.cumsum(counts)
        for part in np.array_split(has, len(has) // 20_000 + 1) if len(has) else ():
            starts = (ends - counts)[part]
            found = self.p["gram"][grams[starts[0] : ends[part[-1]]]]
            sums[part] = np.add.reduceat(found, starts - starts[0], axis=0)
        means = sums / np.maximum(counts, 1)[:, None].astype(np.float32)
        own = self.p["word"][hashes % WORD_BINS] * known[:, None]
        return np.concatenate([own, means], axis=1), (hashes, known, grams, counts)

    def gate_inputs(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.p["w_in"] + self.p["b_in"]

    @staticmethod
    def _direction(x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool):
        """States (T, B, h) of one direction; x (T, B, 3h), mask (T, B)."""
        t, b, h3 = x.shape
        h = h3 // 3
        state, states, kept = np.zeros((b, h), np.float32), np.empty((t, b, h), np.float32), []
        for i in range(t):
            gates = state @ u
            zr = _sigmoid(x[i, :, : 2 * h] + gates[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[i, :, 2 * h :] + r * gates[:, 2 * h :])
            new = state + (z * mask[i, :, None]) * (c - state)
            if keep:
                kept.append((state, z, r, c, gates[:, 2 * h :]))
            state = new
            states[i] = new
        return states, kept

    def windows(self, inputs: np.ndarray, at: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows; ``at`` (B, T) are rows of ``inputs`` (words, 6h)."""
        h = HIDDEN
        at = at.T
        mask = (np.arange(len(at))[:, None] < lengths[None, :]).astype(np.float32)
        x = inputs[at]
        f, kept_f = self._direction(x[..., : 3 * h], self.p["u_f"], mask, keep)
        b, kept_b = self._direction(x[::-1, :, 3 * h :], self.p["u_b"], mask[::-1], keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        energy = both @ self.p["attend"] + (mask - 1) * np.float32(1e4)
        # Far below the highest is as good as nothing, and keeps clear of subnormal numbers.
        weight = np.exp(np.maximum(energy - energy.max(axis=0), -30)) * mask
        weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
        pooled = (both * weight[..., None]).sum(axis=0)
        logits = pooled @ self.p["out"] + self.p["bias"]
        return logits, (mask, kept_f, kept_b, both, weight, pooled)

    # -- training

    def gradients(self, vectors, sources, at, lengths, labels, weights) -> dict:
        """Gradients of the weighted logistic loss over one batch of windows."""
        h, p = HIDDEN, self.p
        logits, (mask, kept_f, kept_b, both, weight, pooled) = self.windows(
            self.gate_inputs(vectors), at, lengths, keep=True
        )
        d_logit = ((_sigmoid(logits) - labels) * weights).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = (both * d_pooled[None]).sum(axis=2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["attend"] = np.einsum("tbh,tb->h", both, d_energy)
        d_both = weight[..., None] * d_pooled[None] + d_energy[..., None] * p["attend"]
        d_f, g["u_f"] = self._back(d_both[..., :h], kept_f, p["u_f"], mask)
        d_b, g["u_b"] = self._back(d_both[::-1, :, h:], kept_b, p["u_b"], mask[::-1])
        d_x = np.concatenate([d_f, d_b[::-1]], axis=2).reshape(-1, 6 * h)
        d_inputs = _summed(at.T.ravel(), d_x, len(vectors))
        g["w_in"], g["b_in"] = vectors.T @ d_inputs, d_inputs.sum(axis=0)
        d_vectors = d_inputs @ p["w_in"].T
        hashes, known, grams, counts = sources
        each = d_vectors[:, WORD_WIDTH:] / np.maximum(counts, 1)[:, None]
        g["word"] = _summed(hashes[known] % WORD_BINS, d_vectors[known, :WORD_WIDTH], WORD_BINS)
        g["gram"] = _summed(grams, np.repeat(each, counts, axis=0), GRAM_BINS)
        return g

    @staticmethod
    def _back(d_states, kept, u, mask):
        t, b, h = d_states.shape
        d_x, d_u = np.zeros((t, b, 3 * h), np.float32), np.zeros_like(u)
        carried = np.zeros((b, h), np.float32)
        for i in range(t - 1, -1, -1):
            state, z, r, c, inner = kept[i]
            m = mask[i, :, None]
            d = d_states[i] + carried
            d_c = d * z * m * (1 - c * c)
            d_z = d * (c - state) * m * z * (1 - z)
            d_r = d_c * inner * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_x[i] = np.concatenate([d_z, d_r, d_c], axis=1)
            d_u += state.T @ d_gates
            carried = d * (1 - z * m) + d_gates @ u.T
        return d_x, d_u


def _summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    if len(order):
        at = at[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Sample(NamedTuple):
    """Windows of labelled documents, their words as numbers."""

    words: list[str]
    at: np.ndarray  # (windows, WINDOW), rows of words
    lengths: np.ndarray
    owner: np.ndarray  # the document of each window
    labels: np.ndarray

    @classmethod
    def of(cls, documents: Iterable[tuple[int, list[str]]]) -> Sample:
        """From labels and windows, each a string of words between spaces."""
        names: dict[str, int] = {}
        rows, lengths, owner, labels = [], [], [], []
        for d, (label, windows) in enumerate(documents):
            labels.append(label)
            for window in windows:
                at = [names.setdefault(w, len(names)) for w in window.split()]
                rows.append(np.array(at + [0] * (WINDOW - len(at)), np.int32))
                lengths.append(len(at))
                owner.append(d)
        at = np.stack(rows) if rows else np.zeros((0, WINDOW), np.int32)
        arrays = (np.array(x, np.int64) for x in (lengths, owner, labels))
        return cls(list(names) or [""], at, *arrays)


def _subset(inputs: tuple, starts: np.ndarray, used: np.ndarray) -> tuple:
    """The word inputs of some words."""
    hashes, grams, counts = inputs
    n = counts[used]
    at = np.repeat(starts[used] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return hashes[used], grams[at], n


def train(
    sample: Sample, prevalence: float = 0.5, steps: int = 160, batch: int = 256
) -> Network:
    """A network from labelled windows.

    Both labels weigh the same in training. Few documents are gone through more
    often, in smaller batches. Every ``CALIBRATE``-th document is left out, and on
    these the scores are made probabilities, given the ``prevalence`` of label 1.
    With labels of one kind only, the bias alone is set; without any, all is clean.
    """
    net = Network()
    labels = sample.labels
    if len(set(labels.tolist())) < 2:
        net.p["out"][:] = 0
        net.p["bias"][:] = 4.0 * (2 * int(labels.max(initial=0)) - 1)
        return net
    inputs = word_inputs(sample.words)
    aside = sample.owner % CALIBRATE == CALIBRATE - 1
    learned = set(labels[np.unique(sample.owner[~aside])].tolist())
    if len(learned) < 2:
        aside[:] = False
    at, lengths, owner = (x[~aside] for x in (sample.at, sample.lengths, sample.owner))
    starts = np.cumsum(inputs[2]) - inputs[2]
    y = labels.astype(np.float32)
    random = np.random.default_rng(SEED)
    odds = _set_log_odds(net, inputs, at, lengths, owner, y)
    unseen = ~net.p["gram"].any(axis=1)
    first_key = np.where(np.arange(at.shape[1]) < lengths[:, None], odds[at], -np.inf).max(axis=1)
    first_key = np.where(y[owner] == 1, first_key, random.random(len(at)))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    batch = min(batch, max(16, len(labels) // 12))
    rounds = max(6, steps // -(-len(labels) // batch))
    share = len(labels) / (2 * np.bincount(labels, minlength=2)).astype(np.float32)
    step = 0
    for turn in range(rounds):
        chosen = _chosen(net, inputs, at, lengths, owner, first_key if turn == 0 else None)
        random.shuffle(chosen)
        for start in range(0, len(chosen), batch):
            part = chosen[start : start + batch]
            used, local = np.unique(at[part], return_inverse=True)
            vectors, sources = net.word_vectors(_subset(inputs, starts, used))
            vectors *= random.random((len(used), 1)) >= DROPOUT
            target = y[owner[part]]
            weight = share[target.astype(int)] / np.float32(len(part))
            grads = net.gradients(
                vectors, sources, local.reshape(len(part), -1), lengths[part], target, weight
            )
            step += 1
            for k, g in grads.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                rate = 0.01 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                net.p[k] -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
                if k in ("word", "gram"):
                    net.p[k] *= np.float32(1 - rate * DECAY)
            net.p["gram"][unseen] = 0
    if aside.any():
        _calibrate(net, inputs, sample, aside, prevalence)
    return net


def _logits(net, inputs, at, lengths) -> np.ndarray:
    gates = net.gate_inputs(net.word_vectors(inputs)[0])
    parts = range(0, len(at), 1024)
    return np.concatenate([net.windows(gates, at[s : s + 1024], lengths[s : s + 1024])[0] for s in parts])


def _calibrate(net: Network, inputs: tuple, sample: Sample, aside: np.ndarray, prevalence: float) -> None:
    """Fit slope and offset on the documents left out, by Newton steps."""
    best = np.full(len(sample.labels), -np.inf)
    np.maximum.at(best, sample.owner[aside], _logits(net, inputs, sample.at[aside], sample.lengths[aside]))
    seen = np.isfinite(best)
    y, x = sample.labels[seen], np.stack([best[seen], np.ones(seen.sum())], axis=1)
    counts = np.bincount(y, minlength=2)
    if counts.min() == 0:
        return
    weight = np.where(y == 1, prevalence / counts[1], (1 - prevalence) / counts[0]) * len(y)
    target = np.where(y == 1, (counts[1] + 1) / (counts[1] + 2), 1 / (counts[0] + 2))
    theta, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (p - target)) + 0.1 * (theta - start))
        theta = theta - np.clip(step, -1, 1)
    net.slope, net.offset = max(0.05, float(theta[0])), float(theta[1])


def _set_log_odds(net, inputs, at, lengths, owner, y) -> np.ndarray:
    """First components of embeddings start as log odds of their bins; those of words.

    Odds are of documents with the bin, by label, each label weighing the same.
    """
    hashes, grams, counts = inputs
    inside = np.arange(at.shape[1]) < lengths[:, None]
    word, document = at[inside], np.repeat(owner, lengths)
    seen = np.unique(document * np.int64(len(hashes)) + word)
    document, word = seen // len(hashes), seen % len(hashes)
    starts = np.cumsum(counts) - counts
    names, number = np.unique(hashes, return_inverse=True)
    sums = _documents(number[word], document, y, len(names))
    of_word, word_documents = _log_odds(sums, y), sums.sum(axis=0)
    net.known = names[word_documents >= MIN_DOCUMENTS]
    of_word = np.where(word_documents >= MIN_DOCUMENTS, of_word, 0)
    net.p["word"][names % WORD_BINS, 0] = of_word
    sums = np.zeros((2, GRAM_BINS), np.int64)
    for first in range(0, len(y), 256):  # some documents at a time: n-grams are many
        part = slice(*np.searchsorted(document, [first, first + 256]))
        n = counts[word[part]]
        at_gram = np.repeat(starts[word[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        sums += _documents(grams[at_gram], np.repeat(document[part], n), y, GRAM_BINS)
    of_gram, gram_documents = _log_odds(sums, y), sums.sum(axis=0)
    net.p["gram"][:, 0] = of_gram
    net.p["gram"][gram_documents < MIN_DOCUMENTS] = 0
    means = np.zeros(len(hashes), np.float32)
    has = np.flatnonzero(counts)
    if len(has):
        means[has] = np.add.reduceat(of_gram[grams], starts[has]) / counts[has]
    return of_word[number] + means


def _documents(found, of, y, size: int) -> np.ndarray:
    """(2, size): documents of label 0 and 1 that have each feature."""
    pairs = np.unique(found * np.int64(len(y)) + of)
    found, of = pairs // len(y), pairs % len(y)
    return np.stack([np.bincount(found[y[of] == k], minlength=size) for k in (0, 1)])


def _log_odds(sums: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smoothed log odds of documents of label 1, each label weighing the same."""
    total = np.bincount(y.astype(int), minlength=2)
    return np.log((sums[1] + 1) / (sums[0] * total[1] / total[0] + 1)).astype(np.float32)


def _chosen(net, inputs, at, lengths, owner, key: np.ndarray | None) -> np.ndarray:
    """Of every document the window of the highest key, by default its score."""
    if key is None:
        key = _logits(net, inputs, at, lengths)
    order = np.lexsort((-key, owner))
    first = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
    return order[first]


class Scorer:
    """Scores whole texts; gate inputs of known words are kept up to ``memory``."""

    def __init__(self, net: Network, memory: int = 150_000, together: int = 4096):
        self._net, self._limit, self._together = net, memory, together
        self._forget()

    def _forget(self) -> None:
        self._rows: dict[str, int] = {}
        self._inputs = np.zeros((self._limit, 6 * HIDDEN), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        found = [*map(self._rows.get, words)]
        if None in found:
            new = list({w for w, i in zip(words, found, strict=True) if i is None})
            if len(self._rows) + len(new) > self._limit:
                self._forget()
                new = list(set(words))
            start = len(self._rows)
            if len(new) > self._limit:
                self._inputs = np.zeros((2 * len(new), 6 * HIDDEN), np.float32)
            inputs = self._net.gate_inputs(self._net.word_vectors(word_inputs(new))[0])
            self._inputs[start : start + len(new)] = inputs
            self._rows.update(zip(new, range(start, start + len(new)), strict=True))
            found = [*map(self._rows.__getitem__, words)]
        return np.array(found, np.int64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        group, words = [], 0
        for i, text in enumerate(texts):
            group.append(i)
            words += len(text or "") // 6 + 1
            if words >= 60_000 or i + 1 == len(texts):
                self._some([texts[j] for j in group], group, out)
                group, words = [], 0
        return out

    def _some(self, texts: list, places: list[int], out: np.ndarray) -> None:
        split = [words_of(t) for t in texts]
        numbers = self._numbers([w for words in split for w in words])
        counts = [len(w) for w in split]
        begins = np.cumsum([0, *counts])
        starts, lengths, owner = [], [], []
        for place, begin, n in zip(places, begins, counts, strict=False):
            for s in window_starts(n):
                starts.append(begin + s)
                lengths.append(min(WINDOW, n - s))
                owner.append(place)
        starts, lengths, owner = np.array(starts), np.array(lengths), np.array(owner)
        padded = np.concatenate([numbers, np.zeros(WINDOW, np.int64)])
        # Windows of like length go together, so short ones take few steps.
        order = np.argsort(lengths, kind="stable")
        best = np.full(out.shape, -np.inf)
        for s in range(0, len(order), self._together):
            part = order[s : s + self._together]
            longest = max(1, int(lengths[part].max()))
            at = padded[np.minimum(starts[part][:, None] + np.arange(longest), len(padded) - 1)]
            logits, _ = self._net.windows(self._inputs, at, lengths[part])
            np.maximum.at(best, owner[part], logits)
        scaled = self._net.slope * best[places] + self._net.offset
        out[places] = np.where(np.array(counts) > 0, _sigmoid(scaled), 0.0)


class Odds(NamedTuple):
    """Log odds of words and n-grams in the whole sampled texts, by bin."""

    word: np.ndarray
    gram: np.ndarray

    def of(self, words: list[str]) -> np.ndarray:
        """Like the first components of the embeddings: of each word, and of its n-grams."""
        hashes, grams, counts = word_inputs(words)
        out = self.word[hashes % ODDS_BINS].copy()
        has = np.flatnonzero(counts)
        if len(has):
            starts = np.cumsum(counts) - counts
            out[has] += np.add.reduceat(self.gram[grams], starts[has]) / counts[has]
        return out


def count_odds(sample: DataFrame) -> Odds:
    """Odds from all words of the documents of :func:`labelled_sample`.

    Tasks send, for each bin, the number of documents of each label that have it.
    """
    size = ODDS_BINS + GRAM_BINS + 1  # the last bin counts documents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, size), np.int64)
        for rows in batches:
            for text, label in zip(rows["text"].tolist(), rows["label"].tolist(), strict=True):
                hashes, grams, _ = word_inputs(list(set(words_of(text))))
                bins = np.concatenate([hashes % ODDS_BINS, ODDS_BINS + grams, [size - 1]])
                sums[label, np.unique(bins)] += 1
        label, found = np.nonzero(sums)
        yield pd.DataFrame({"label": label, "bin": found, "n": sums[label, found]})

    counted = sample.mapInPandas(run, "label long, bin long, n long")
    rows = counted.groupBy("label", "bin").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((2, size), np.int64)
    sums[rows["label"].to_numpy(), rows["bin"].to_numpy()] = rows["n"].to_numpy()
    labels = np.repeat([0, 1], sums[:, -1])
    if len(set(labels.tolist())) < 2:
        return Odds(np.zeros(ODDS_BINS, np.float32), np.zeros(GRAM_BINS, np.float32))
    odds = np.where(sums.sum(axis=0) >= MIN_DOCUMENTS, _log_odds(sums, labels), 0).astype(np.float32)
    return Odds(odds[:ODDS_BINS], odds[ODDS_BINS:-1])


def training_windows(text: str | None, label: int, odds: Odds) -> list[str]:
    """Of all windows those whose words have the highest odds, in the order of the text.

    A window ranks by its highest word, then by the mean of its words. Half of the windows of
    a document of label 0 are spread over the others instead, so that clean text is ordinary.
    """
    words = words_of(text)
    starts = list(window_starts(len(words)))
    kept = np.arange(len(starts))
    if len(starts) > SAMPLE_WINDOWS:
        names, number = np.unique(words, return_inverse=True)
        of_word = odds.of(names.tolist())[number]
        windows = [of_word[s : s + WINDOW] for s in starts]
        order = np.lexsort(([-w.mean() for w in windows], [-w.max() for w in windows]))
        top = SAMPLE_WINDOWS if label == 1 else SAMPLE_WINDOWS // 2
        kept, others = order[:top], np.sort(order[top:])
        spread = np.linspace(0, len(others) - 1, SAMPLE_WINDOWS - top).astype(int)
        kept = np.sort(np.concatenate([kept, others[spread]]))
    return [" ".join(words[starts[k] : starts[k] + WINDOW]) for k in kept]


def fit_on(docs: DataFrame, labels: DataFrame, target: str = "toxic", size: int = SAMPLE) -> Network:
    """A network of ``labels[target]``, from a bounded sample of ``docs``.

    Of each sampled document at most ``SAMPLE_WINDOWS`` windows come to the driver,
    chosen in the tasks among all its windows.
    """
    sample = labelled_sample(docs, labels, target, size)
    odds = count_odds(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            pairs = zip(rows["text"].tolist(), rows["label"].tolist(), strict=True)
            out = [training_windows(text, label, odds) for text, label in pairs]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "label": rows["label"], "windows": out})

    rows = sample.mapInPandas(run, "doc_id long, label int, windows array<string>")
    # Row by row, so that the driver keeps numbers of words only.
    ordered = rows.orderBy("doc_id", "windows").toLocalIterator()
    known = labels.where(F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    prevalence = known.agg(F.avg((F.col(target) == 1).cast("double"))).first()[0]
    return train(Sample.of((r["label"], r["windows"]) for r in ordered), prevalence or 0.5)


def scoring(net: Network):
    """A column function from texts to scores."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(net)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()), dtype="float64")

    return score


def score_toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` and ``score``, 0 to 1, of every whole text (null: empty)."""
    return docs.withColumn("score", scoring(net)("text"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored; 1 from 0.3 on."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    net = fit_on(docs, table(spark, folder, "labels"))
    return score_toxicity(docs, net).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )
