"""Item difficulty and discrimination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysmith.functions.numbers import round_mean, round_to
from tallysmith.operators.common import keyed
from tallysmith.operators.ensemble import majority

ITEM = ["question_id", "area", "question_type"]

TRIVIAL, BROKEN = 0.95, 0.05


def _item_scores(trials: DataFrame, vote: bool) -> DataFrame:
    score = majority() if vote else F.avg("binary_score")
    per_model = keyed(trials, [*ITEM, "model"]).groupBy(*ITEM, "model").agg(score.alias("score"))
    return per_model.groupBy(*ITEM).agg(
        F.avg("score").alias("fraction"), F.stddev_pop("score").alias("spread")
    )


def item_stats(trials: DataFrame, vote: bool = False) -> DataFrame:
    """Per item: mean over models (difficulty) and spread over models (discrimination).

    ``vote=False`` averages the runs of a model, ``vote=True`` takes their majority first.
    """
    return _item_scores(trials, vote).select(
        *ITEM,
        round_mean("fraction", 3).alias("fraction_correct"),
        round_mean("spread", 3).alias("discrimination"),
        (F.col("fraction") >= TRIVIAL).cast("int").alias("trivial"),
        (F.col("fraction") <= BROKEN).cast("int").alias("broken"),
    )


def psychometrics(trials: DataFrame) -> DataFrame:
    """Majority-vote item statistics rolled up per area and question type."""
    items = _item_scores(trials, vote=True)
    return items.groupBy("area", "question_type").agg(
        F.count("*").alias("n_items"),
        round_mean(F.avg("fraction"), 3).alias("mean_difficulty"),
        round_mean(F.avg("spread"), 3).alias("mean_discrimination"),
        round_to(F.avg((F.col("fraction") >= TRIVIAL).cast("int")), 3).alias("pct_trivial"),
        round_to(F.avg((F.col("fraction") <= BROKEN).cast("int")), 3).alias("pct_broken"),
    )
