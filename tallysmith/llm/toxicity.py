"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallysmith.llm import linear
from tallysmith.llm.hashing import U64, chained, joined, span_hashes, spans

DIM_BITS = 20
LEAST = 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 5.0, 0.1
EPOCHS = 4
_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def features(texts: list, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), sorted and distinct: words, word pairs, and pairs with one word left out.

    With ``live`` only features that it marks are returned.
    """
    data, begin = joined(texts)
    data = _FOLD[data]
    starts, ends = spans(_WORD[data])
    doc = np.searchsorted(begin, starts, side="right") - 1
    words = span_hashes(data, starts, ends)
    parts = [(words, doc), chained(words, doc, 1, 1), chained(words, doc, 2, 2)]
    keys = []
    for hashes, owner in parts:
        feature = (hashes >> U64(64 - DIM_BITS)).astype(np.int64)
        if live is not None:
            kept = live[feature]
            feature, owner = feature[kept], owner[kept]
        keys.append((owner.astype(np.int64) << DIM_BITS) | feature)
    keys = np.unique(np.concatenate(keys))
    return keys >> DIM_BITS, keys & ((1 << DIM_BITS) - 1)


def ftrl(y: np.ndarray, ends: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Weights after ``EPOCHS`` passes of FTRL-proximal with per-coordinate rates.

    Coordinates whose gradient sum stays within L1 have weight zero.
    """
    z, n = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    bias_z = bias_n = bias = 0.0
    draw = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(y)):
            at = feature[ends[i] : ends[i + 1]]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - y[i]
            root = np.sqrt(ni + g * g)
            z[at] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2)
    return weights(z, n)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, rest: int = 2, rows: int = linear.FIT_ROWS) -> linear.Model:
    """A model of ``label``, learned from about ``rows`` labelled texts whose crc32 of the key is not held out.

    Each shard of the sample runs FTRL on its own and the weights are averaged; without labelled rows, or
    with one class only, all weights stay near zero and scores near the middle or that class.
    """
    sample = linear.labelled_sample(docs, labels, label, modulus, rest, rows)
    return linear.train(sample, features, 1 << DIM_BITS, False, ftrl)


def classify(docs: DataFrame, model: linear.Model, modulus: int = 4, rest: int = 2, least: float = LEAST) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; only the text enters a score.

    NULL and empty texts get the score of no features.  A NULL key is not held out.  Repeated rows repeat.
    """
    return linear.verdicts(linear.score(docs, model, features, False), modulus, rest, least)
