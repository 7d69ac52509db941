"""Quality classifier: a support vector machine on naive Bayes features.

Texts become indicators of n-grams: of characters, and of character shapes in
which runs are drawn together (``Word, word!!`` gives ``Aa, a!``). Each indicator
is scaled by the log ratio of its smoothed counts in the two classes, and a
linear model with hinge loss is fitted by dual coordinate descent.

The model is fitted on the driver on a bounded sample (``SAMPLE`` documents, half
of each class; executors send distinct feature numbers, as a bitmap of ``FEATURES``
bits where that is shorter, so at most 8 KB of each document). Scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.registry import query, table
from lodestone.llm.samples import held_out, labelled_sample

SAMPLE = 8000
FEATURES = 1 << 16
SHAPE_GRAMS = range(1, 7)
CHARACTER_GRAMS = range(2, 4)
KEEP = 0.7

_ODD = np.uint32(0x9E3779B1)
_SHAPE = np.array(
    [
        ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c
        for c in range(256)
    ],
    np.uint8,
)


def _grams(codes: np.ndarray, sizes: range, salt: int) -> Iterator[np.ndarray]:
    codes = codes.astype(np.uint32) + np.uint32(salt)
    rolled = np.zeros(len(codes), np.uint32)
    for n in range(1, sizes.stop):
        if len(codes) < n:
            return
        rolled = (rolled[: len(codes) - n + 1] * _ODD) ^ codes[n - 1 :]
        if n in sizes:
            mixed = (rolled ^ np.uint32(n)) * _ODD
            yield (mixed ^ (mixed >> np.uint32(15))) & np.uint32(FEATURES - 1)


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text, sorted."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    shape = _SHAPE[data]
    if len(shape):
        shape = shape[np.r_[True, shape[1:] != shape[:-1]]]
    seen = np.zeros(FEATURES, bool)
    for codes, sizes, salt in ((shape, SHAPE_GRAMS, 1 << 12), (lower, CHARACTER_GRAMS, 1 << 20)):
        for found in _grams(codes, sizes, salt):
            seen[found] = True
    return np.flatnonzero(seen)


def packed(found: np.ndarray) -> bytes:
    """Feature numbers in a row, or all features as bits if that is shorter."""
    if 4 * len(found) < FEATURES // 8:
        return found.astype("<u4").tobytes()
    bits = np.zeros(FEATURES, bool)
    bits[found] = True
    return np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < FEATURES // 8:
        return np.frombuffer(data, "<u4").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


class Model(NamedTuple):
    """``score`` is 1 / (1 + exp(-(slope * margin + offset)))."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / max(1.0, np.sqrt(len(found))) + self.bias)

    def score(self, text: str | None) -> float:
        at = self.slope * self.margin(features(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(at, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    sums = np.ones((2, FEATURES))
    for found, label in zip(rows, labels, strict=True):
        sums[label][found] += 1
    shares = sums / sums.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, rounds: int = 20) -> Model:
    """Dual coordinate descent on the scaled, length-normed indicators.

    Labels of one kind only give a model that says so everywhere; without any, all is good.
    """
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        offset = 4.0 * (2 * int(labels.min(initial=1)) - 1)
        return Model(np.zeros(FEATURES), 0.0, 1.0, offset)
    ratio = log_count_ratio(rows, labels)
    y = 2.0 * labels - 1
    values = [ratio[r] / max(1.0, np.sqrt(len(r))) for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    upper = c * len(y) / (2 * np.bincount(labels, minlength=2))[labels]  # both classes weigh the same
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
            alpha[i] = new
        if moved < 1e-3:
            break
    margins = np.array([w[r] @ v + bias for r, v in zip(rows, values, strict=True)])
    slope, offset = _logistic(margins, labels)
    return Model((w * ratio).astype(np.float64), bias, slope, offset)


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Margins to probabilities, by Newton steps on slightly smoothed labels."""
    target = np.where(labels == 1, 1 - 1 / (2 + (labels == 1).sum()), 1 / (2 + (labels == 0).sum()))
    x, theta = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit_on(docs: DataFrame, labels: DataFrame, target: str = "quality", size: int = SAMPLE) -> Model:
    """A model of ``labels[target]``, from a bounded sample of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [packed(features(t)) for t in rows["text"].tolist()]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "label": rows["label"], "found": found})

    sample = labelled_sample(docs, labels, target, size)
    rows = sample.mapInPandas(run, "doc_id long, label int, found binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["found"])))
    found = [unpacked(r["found"]) for r in rows]
    return fit(found, np.array([r["label"] for r in rows], np.int64))


def scoring(model: Model):
    """A column function from texts to scores."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts.tolist()], dtype="float64")

    return score


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and ``score``, 0 to 1, of every whole text (null: empty)."""
    return docs.withColumn("score", scoring(model)("text"))


@query("op6_quality")
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored; 1 from 0.7 on."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit_on(docs, table(spark, folder, "labels"))
    scored = score_quality(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= KEEP).cast("int").alias("predicted"),
    )
