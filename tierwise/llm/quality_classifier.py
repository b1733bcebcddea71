"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters or digits and runs of other marks; their unigrams and bigrams are hashed into
2^BITS features, a text's features share a total weight of one by root counts. Training takes one example at a time with
per-coordinate step sizes and L1 and L2 penalties, so most weights stay zero; a score is a sparse dot product.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import WordHash, mix
from .linear import calibrated, held_out, scored, sigmoid, train, training_rows

BITS = 18
#: Labelled rows to learn from, at most; half of them of each label.
TRAIN_ROWS = 6_000
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
_hashes = WordHash(11)


def _forget() -> None:
    _hashes.clear()


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features of a text and their values, of unit length together."""
    words = _TOKEN.findall(text)
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    h = _hashes.of(words)
    both = np.concatenate([h, mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])])
    at, n = np.unique((both >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    value = np.sqrt(n)
    return at, value / np.sqrt((value**2).sum())


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 0.1) -> dict[str, np.ndarray]:
    """Weights, and the bias as the last one. No rows: all zero."""
    size = 1 << BITS
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    rows = [features(t) for t in texts]
    for k in range(epochs):
        for i in np.random.default_rng(k).permutation(len(rows)):
            at, x = np.r_[rows[i][0], size], np.r_[rows[i][1], 1.0]
            l1s = np.where(at == size, 0.0, l1)
            w[at] = np.where(np.abs(z[at]) <= l1s, 0.0, -(z[at] - np.sign(z[at]) * l1s) / ((beta + np.sqrt(n[at])) / alpha + l2))
            g = (sigmoid(float(w[at] @ x)) - y[i]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w[at]
            n[at] += g * g
    l1s = np.r_[np.full(size, l1), 0.0]
    return {"w": np.where(np.abs(z) <= l1s, 0.0, -(z - np.sign(z) * l1s) / ((beta + np.sqrt(n)) / alpha + l2))}


def margin(w: np.ndarray, text: bytes) -> float:
    at, x = features(text)
    return float(w[at] @ x + w[-1])


def fit_calibrated(texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
    return calibrated(fit, margin, texts, y)


def score(model: dict[str, np.ndarray], texts: list[bytes]) -> list[float]:
    out = [sigmoid(margin(model["w"], t)) for t in texts]
    _hashes.trim()
    return out


def quality_classifier(docs: DataFrame, labels: DataFrame, modulus: int = 4, fold: int = 2, threshold: float = 0.7, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Scores every document by a classifier learned from the labels outside the held-out fold.

    docs: doc_id, text; labels: doc_id, quality; other columns are ignored. Learns from at most
    ``train_rows`` labelled ids, half of them of each label at most. Returns doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Null and empty texts get the bias alone. Null ids are held out. An id labelled twice has the larger
    label. Without labels of both kinds the weights are what one kind gives; without any, every score is 0.5. Empty table: empty result. Repeated rows are all scored.
    """
    rows = training_rows(docs, labels, "quality", ~held_out(modulus, fold), train_rows)
    return scored(docs, train(rows, fit_calibrated), score, held_out(modulus, fold), threshold, _forget)
