"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The character 4- to 6-grams of a lower-cased text (code points; white space as one blank) are hashed into 2^BITS
features; a feature's value is the logarithm of 1 + its count. Each has the smoothed log ratio of its mean value
in toxic and in other texts; ratios of rare or undecided n-grams are cut to zero. A logistic regression is learned
on the features times their ratios, so a score is a sum of products over the n-grams that a text holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .linear import calibrated, held_out, scored, sigmoid, train, training_rows

BITS, ORDERS = 20, (4, 5, 6)
#: Labelled rows to learn from, at most; half of them of each label.
TRAIN_ROWS = 6_000


def grams(text: bytes) -> np.ndarray:
    """Numbers of a text's n-grams, repeats included."""
    words = text.decode(errors="replace").lower().split()
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
    out = []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = (h ^ c[i : i + m]) * np.uint32(0x01000193) + np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def features(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their values."""
    at, n = np.unique(numbers, return_counts=True)
    return at, np.log1p(n)


def ratios(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, least: int, cut: float) -> np.ndarray:
    """Log ratio of each feature's smoothed mean values in toxic and in other rows; 0 in fewer than ``least`` rows or below the cut."""
    size = 1 << BITS
    pos, neg, rows_with = np.zeros(size), np.zeros(size), np.zeros(size)
    for (at, x), v in zip(rows, y, strict=True):
        (pos if v else neg)[at] += x
        rows_with[at] += 1
    ratio = np.log((pos + 0.5) / (max(1.0, y.sum()) + 1)) - np.log((neg + 0.5) / (max(1.0, (1 - y).sum()) + 1))
    ratio[(rows_with < least) | (np.abs(ratio) < cut)] = 0
    return ratio


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 12, least: int = 2, cut: float = 2.0, rate: float = 0.5, l2: float = 1e-4) -> dict[str, np.ndarray]:
    """Weights already multiplied by the ratios, and the bias as the last one. No rows: all zero."""
    size = 1 << BITS
    rows = [features(grams(t)) for t in texts]
    ratio = ratios(rows, y, least, cut)
    live = np.flatnonzero(ratio)
    number = np.full(size, -1)
    number[live] = np.arange(len(live))
    scaled = []
    for at, x in rows:
        k = number[at]
        scaled.append((k[k >= 0], x[k >= 0] * ratio[at[k >= 0]]))
    w, b, square = np.zeros(len(live)), 0.0, np.full(len(live), 1e-8)
    weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
    for k in range(epochs if len(live) else 0):
        for i in np.random.default_rng(k).permutation(len(scaled)):
            at, x = scaled[i]
            g = weight[i] * (sigmoid(float(w[at] @ x + b)) - y[i])
            d = g * x + l2 * w[at]
            square[at] += d * d
            w[at] -= rate * 0.1 * d / np.sqrt(square[at])
            b -= rate * 0.02 * g
    out = np.zeros(size + 1)
    out[live] = w * ratio[live]
    out[-1] = b
    return {"w": out}


def margin(w: np.ndarray, text: bytes) -> float:
    numbers = grams(text)
    at, x = features(numbers[w[numbers] != 0])
    return float(w[at] @ x + w[-1])


def fit_calibrated(texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
    return calibrated(fit, margin, texts, y)


def score(model: dict[str, np.ndarray], texts: list[bytes]) -> list[float]:
    return [sigmoid(margin(model["w"], t)) for t in texts]


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, fold: int = 1, threshold: float = 0.7, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Scores every document by a classifier learned from the labels outside the held-out fold.

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored. Learns from at most
    ``train_rows`` labelled ids, half of them of each label at most. Returns doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Null and empty texts get the bias alone. Null ids are held out. An id labelled twice has the larger
    label. No labels: every score is 0.5. Empty table: empty result. Repeated rows are all scored.
    """
    rows = training_rows(docs, labels, "toxic", ~held_out(modulus, fold), train_rows)
    return scored(docs, train(rows, fit_calibrated), score, held_out(modulus, fold), threshold)
