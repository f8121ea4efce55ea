"""Linear models over hashed features: labelled sample, training in shards, calibration, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysmith.llm.hashing import batches
from tallysmith.llm.shared import held_out, measured, small_batches
from tallysmith.operators.common import checkpointed

#: A featurizer gives (document, feature) arrays, without repeats, for a list of texts.
Featurizer = Callable[[list], tuple[np.ndarray, np.ndarray]]
#: Labelled rows a classifier is fitted on, about, and how many go into one shard.
FIT_ROWS = 20_000
SHARD_ROWS = 5_000


@dataclass
class Model:
    """Weights of all features (mostly zero), and the line that turns a margin into log odds."""

    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, doc: np.ndarray, feature: np.ndarray, docs: int, norm: bool) -> np.ndarray:
        total = np.bincount(doc, weights=self.weights[feature], minlength=docs)
        if norm:
            total = total / np.sqrt(np.maximum(np.bincount(doc, minlength=docs), 1))
        return total

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, rows: int = FIT_ROWS,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(shard, y, text): about ``rows`` labelled documents, chosen by a hash of the key, none held out.

    Rows without key or label are left out; labels of a repeated key are averaged, and of several documents with one
    key one is drawn by a hash of its text, so a key on very many rows is one row of the sample.  Only the chosen keys
    are broadcast, so no other texts are shuffled.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key, modulus, rest))
    known = known.groupBy(F.col(key).alias("_key")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    known = checkpointed(known)
    share = min(1.0, rows / max(known.count(), 1))
    draw = F.pmod(F.xxhash64(F.lit(7), "_key"), F.lit(1 << 20)) < int(share * (1 << 20))
    chosen, count = measured(known.filter(draw), 2 * rows)
    shards = max(1, round(count / SHARD_ROWS))
    shard = F.pmod(F.xxhash64(F.lit(8), "_key"), F.lit(shards)).cast("int").alias("shard")
    picked = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(chosen, "_key")
    drawn = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    single = picked.groupBy("_key").agg(drawn, F.first("y").alias("y"))
    return checkpointed(single.select(shard, "y", "text"))


def train(sample: DataFrame, features: Featurizer, dims: int, norm: bool, fit: Callable) -> Model:
    """Mean of the weights that ``fit(y, offsets, feature)`` finds on each shard, then Platt scaling.

    A shard is one task of about ``SHARD_ROWS`` documents; the sum of the weights is at most ``dims`` rows.
    """

    small_batches(sample.sparkSession)

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        texts, y = frame["text"].tolist(), frame["y"].to_numpy(dtype=np.int64)
        del frame
        sizes, parts = [], [np.zeros(0, dtype=np.int32)]
        for a, b in batches(texts):
            doc, feature = features(texts[a:b])
            sizes.append(np.bincount(doc, minlength=b - a))
            parts.append(feature.astype(np.int32))
        del texts
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        w = fit(y, ends, np.concatenate(parts))
        used = np.flatnonzero(w)
        return pd.DataFrame({"feature": used.astype(np.int64), "w": w[used].astype(np.float64)})

    shards = max(sample.select("shard").distinct().count(), 1)
    found = sample.groupBy("shard").applyInPandas(shard, "feature long, w double")
    weights = np.zeros(dims, dtype=np.float32)
    for row in found.groupBy("feature").agg(F.sum("w").alias("w")).toLocalIterator():
        weights[row["feature"]] = row["w"] / shards
    model = Model(weights)

    def margins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in batches(texts):
                m = model.margins(*features(texts[a:b]), b - a, norm)
                yield pd.DataFrame({"y": frame["y"].to_numpy()[a:b], "m": m})

    # A pair of numbers for each of the sampled rows.
    seen = sample.select("y", "text").mapInPandas(margins, "y int, m double").toPandas()
    model.slope, model.offset = platt(seen["m"].to_numpy(), seen["y"].to_numpy(dtype=np.float64))
    return model


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the margins, with smoothed targets; (1, 0) without both classes."""
    good, bad = y.sum(), len(y) - y.sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(float(np.std(margin)), 1e-9)
    x = np.column_stack([margin / scale, np.ones(len(margin))])
    beta = np.array([1.0, np.log((good + 1) / (bad + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, grad)
        size = float(np.abs(step).max())
        beta -= step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def score_column(
    docs: DataFrame, model: Model, features: Featurizer, norm: bool, text: str = "text", name: str = "score"
) -> DataFrame:
    """All rows and columns of ``docs``, and ``name``: whole texts, no shuffle. NULL counts as the empty text."""
    live = model.weights != 0
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        texts, out = texts.tolist(), [np.zeros(0)]
        for a, b in batches(texts):
            doc, feature = features(texts[a:b]) if norm else features(texts[a:b], live)
            out.append(model.scores(model.margins(doc, feature, b - a, norm)))
        return pd.Series(np.concatenate(out))

    return docs.withColumn(name, scored(F.col(text)))


def score(docs: DataFrame, model: Model, features: Featurizer, norm: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return score_column(rows, model, features, norm).select("doc_id", "score")


def verdicts(scores: DataFrame, modulus: int, rest: int, least: float) -> DataFrame:
    return scores.select(
        "doc_id", held_out("doc_id", modulus, rest).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
