"""Accuracy tables with confidence bounds and the model leaderboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.functions.numbers import round_mean, round_to, share
from tallysmith.functions.stats import wilson_bounds
from tallysmith.operators.common import keyed


def _score_sums() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.sum("binary_score").alias("correct"),
        F.sum("rubric_score").alias("rubric_sum"),
        F.count("rubric_score").alias("rubric_n"),
        F.sum("is_refusal").alias("refusals"),
    ]


def accuracy_table(trials: DataFrame, group: Sequence[str]) -> DataFrame:
    """Accuracy per (model, *group) with Wilson bounds, rubric mean, refusals and run-to-run spread.

    The raw rows are combined once, per run; everything else works on those few sums.
    """
    keys = ["model", *group]
    per_run = keyed(trials, keys).groupBy(*keys, "run").agg(*_score_sums())
    total = per_run.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "correct", "rubric_sum", "rubric_n", "refusals")],
        F.stddev_pop(F.when(F.col("run").isNotNull(), share(F.col("correct"), F.col("n")))).alias("spread"),
    )
    low, high = wilson_bounds("correct", "n")
    return total.select(
        *keys,
        "n",
        round_to(share(F.col("correct"), F.col("n")), 4).alias("binary_accuracy"),
        round_to(low, 4).alias("wilson_low"),
        round_to(high, 4).alias("wilson_high"),
        round_to(share(F.col("rubric_sum"), F.col("rubric_n")), 4).alias("rubric_mean"),
        round_to(share(F.col("refusals"), F.col("n")), 4).alias("refusal_rate"),
        round_mean(F.coalesce("spread", F.lit(0.0)), 4).alias("run_acc_std"),
    )


# Response figures of the leaderboard: column, name and digits.
RESPONSE_FIGURES = (
    ("response_fk_grade", "mean_response_fk_grade", 2),
    ("total_tokens", "mean_total_tokens", 1),
    ("reasoning_tokens", "mean_reasoning_tokens", 1),
)


def response_means(responses: DataFrame) -> DataFrame:
    """Mean reading grade and token counts per model."""
    return keyed(responses, ["model"]).groupBy("model").agg(
        *[round_mean(F.avg(column), digits).alias(name) for column, name, digits in RESPONSE_FIGURES]
    )


def leaderboard(trials: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Models ranked by macro accuracy (every area weighs the same); micro weighs every answer the same.

    Rows are combined once per (model, area); the ranking window sees one row per model. Response figures
    come from ``responses``, or from the trials themselves when these carry them, without a second scan.
    """
    carried = [f for f in RESPONSE_FIGURES if responses is None and f[0] in trials.columns]
    sums = [s for c, _, _ in carried for s in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))]
    per_area = keyed(trials, ["model"]).groupBy("model", "area").agg(*_score_sums(), *sums)
    in_area = F.col("area").isNotNull()
    board = per_area.groupBy("model").agg(
        F.avg(F.when(in_area, share(F.col("correct"), F.col("n")))).alias("macro"),
        share(F.sum("correct"), F.sum("n")).alias("micro"),
        F.avg(F.when(in_area, share(F.col("rubric_sum"), F.col("rubric_n")))).alias("rubric"),
        share(F.sum("refusals"), F.sum("n")).alias("refusal"),
        F.sum("n").alias("n_items"),
        *[share(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(name) for c, name, _ in carried],
    )
    board = board.select(
        "model",
        round_mean("macro", 4).alias("macro_accuracy"),
        round_to("micro", 4).alias("micro_accuracy"),
        round_mean("rubric", 4).alias("rubric_macro"),
        round_to("refusal", 4).alias("refusal_rate"),
        "n_items",
        *[round_mean(name, digits).alias(name) for _, name, digits in carried],
    )
    if responses is not None:
        board = board.join(response_means(responses), "model", "left")
    order = Window.orderBy(F.desc_nulls_last("macro_accuracy"), "model")
    return board.select(F.row_number().over(order).alias("rank"), *board.columns)
