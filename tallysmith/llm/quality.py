"""Quality: a hinge-loss linear model over n-gram indicators scaled by Naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysmith.llm import linear
from tallysmith.llm.hashing import U64, batches, chained, joined, scramble, span_hashes, spans
from tallysmith.llm.shared import fresh, small_batches

DIM_BITS = 18
LEAST = 0.3
COST, EPOCHS, SMOOTH = 1.0, 10, 1.0
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_WIDE = np.array([b >= 128 for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Last byte of a token: letter or digit, full stop or comma, exclamation or question mark, bracket, other sign.
_TAIL = np.array(
    [0 if chr(b).isalnum() or b >= 128 else 1 if chr(b) in ".,;:" else 2 if chr(b) in "!?" else 3 if chr(b) in "()[]{}\"'" else 4
     for b in range(256)]
)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A small code of how each token looks: case, length, signs, and whether it repeats the one before."""

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[data])))
        return sums[ends] - sums[starts]

    size = ends - starts
    upper, lower, digit, wide = share(_UPPER), share(_LOWER), share(_DIGIT), share(_WIDE)
    signs = size - upper - lower - digit - wide
    case = np.where(upper + lower == 0, 0, np.where(lower == 0, 3, np.where(upper == 0, 1, 2)))
    repeats = np.zeros(len(words), dtype=np.int64)
    if len(words) > 1:
        repeats[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    code = case
    for value, kinds in (
        (np.searchsorted([2, 4, 9, 17, 40], size, side="right"), 6), (_TAIL[data[ends - 1]], 5),
        (np.minimum(signs, 3), 4), (np.minimum(digit, 2), 3), ((signs == size).astype(np.int64), 2), (repeats, 2),
    ):
        code = code * kinds + value
    return code


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), sorted and distinct: words, and one to three neighbouring token shapes."""
    data, begin = joined(texts)
    starts, ends = spans(~_SPACE[data])
    doc = np.searchsorted(begin, starts, side="right") - 1
    words = span_hashes(_FOLD[data], starts, ends)
    shape = scramble(_shapes(data, starts, ends, words, doc).astype(U64) + U64(1 << 32))
    pairs, pair_doc = chained(shape, doc, 1, 3)
    triples, triple_doc = chained(pairs, pair_doc, 1, 4)  # two pairs that overlap are three tokens
    parts = [(words, doc), (shape, doc), (pairs, pair_doc), (triples, triple_doc)]
    keys = [(d.astype(np.int64) << DIM_BITS) | (h >> U64(64 - DIM_BITS)).astype(np.int64) for h, d in parts]
    keys = np.unique(np.concatenate(keys))
    return keys >> DIM_BITS, keys & ((1 << DIM_BITS) - 1)


def log_count_ratios(sample: DataFrame) -> np.ndarray:
    """log of the smoothed, normalised counts of each feature in good over bad documents of the whole sample."""

    small_batches(sample.sparkSession)

    def counted(frames):
        good, bad = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)
        for frame in frames:
            texts, y = frame["text"].tolist(), frame["y"].to_numpy()
            for a, b in batches(texts):
                doc, feature = features(texts[a:b])
                of = y[a:b][doc] > 0
                good += np.bincount(feature[of], minlength=1 << DIM_BITS)
                bad += np.bincount(feature[~of], minlength=1 << DIM_BITS)
        used = np.flatnonzero(good + bad)
        yield pd.DataFrame({"feature": used, "good": good[used], "bad": bad[used]})

    sums = sample.select("y", "text").mapInPandas(counted, "feature long, good double, bad double")
    good, bad = np.full(1 << DIM_BITS, SMOOTH), np.full(1 << DIM_BITS, SMOOTH)
    for row in sums.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toLocalIterator():
        good[row["feature"]] += row["good"]
        bad[row["feature"]] += row["bad"]
    return np.log((good / good.sum()) / (bad / bad.sum())).astype(np.float32)


def support_weights(ratios: np.ndarray):
    """A trainer: weights over indicators times ratios by dual coordinate descent on the hinge loss."""

    def train(y: np.ndarray, ends: np.ndarray, feature: np.ndarray) -> np.ndarray:
        sign = np.where(y > 0, 1.0, -1.0)
        rows = [feature[ends[i] : ends[i + 1]] for i in range(len(y))]
        values = [ratios[r] / np.sqrt(max(len(r), 1)) for r in rows]
        square = np.array([float(v @ v) for v in values]) + 1.0  # and a constant
        # Errors on the rarer class cost more, so that both classes weigh the same.
        share = max(y.mean(), 1e-9) if len(y) else 1.0
        most = COST * np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-9))
        alpha, w, bias = np.zeros(len(y)), np.zeros(1 << DIM_BITS), 0.0
        draw = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for i in draw.permutation(len(y)):
                slope = sign[i] * (w[rows[i]] @ values[i] + bias) - 1.0
                new = min(max(alpha[i] - slope / square[i], 0.0), most[i])
                if new != alpha[i]:
                    step = (new - alpha[i]) * sign[i]
                    w[rows[i]] += step * values[i]
                    bias += step
                    alpha[i] = new
        return w * ratios  # the constant goes into the calibration

    return train


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, rest: int = 0, rows: int = linear.FIT_ROWS) -> linear.Model:
    """A model of ``label`` from about ``rows`` labelled texts that are not held out.

    Log-count ratios come from the whole sample; each shard of it then solves its own dual problem, and the
    weights are averaged.  Without labelled rows, or with one class only, scores say nothing.
    """
    sample = linear.labelled_sample(docs, labels, label, modulus, rest, rows)
    return linear.train(sample, features, 1 << DIM_BITS, True, support_weights(log_count_ratios(sample)))


def classify(docs: DataFrame, model: linear.Model, modulus: int = 5, rest: int = 0, least: float = LEAST) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; only the text enters a score.

    NULL and empty texts get the score of no features.  A NULL key is not held out.  Repeated rows repeat.
    """
    return linear.verdicts(linear.score(docs, model, features, True), modulus, rest, least)


def keep_good(docs: DataFrame, model: linear.Model, least: float = LEAST, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``least`` or more. One pass over the rows."""
    name = fresh(docs, "_score")
    scores = linear.score_column(docs, model, features, True, text, name)
    return scores.filter(F.col(name) >= least).drop(name)
