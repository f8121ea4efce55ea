"""Reading level and token reports, usage sums and stage progress."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysmith.functions.numbers import band_distance, round_mean, round_to
from tallysmith.operators.common import keyed

TOKEN_COLUMNS = {
    "prompt_tokens": "input",
    "completion_tokens": "output",
    "reasoning_tokens": "reasoning",
    "total_tokens": "total",
}


def reading_level(responses: DataFrame, low: float, high: float) -> DataFrame:
    """Mean grade and ease per model, area and type, and how far the mean lies outside the band."""
    keys = ["model", "area", "question_type"]
    means = keyed(responses, keys).groupBy(*keys).agg(
        F.avg("response_fk_grade").alias("grade"),
        F.avg("response_reading_ease").alias("ease"),
        F.count("*").alias("n"),
    )
    return means.select(
        *keys,
        round_mean("grade", 2).alias("mean_fk_grade"),
        round_mean("ease", 2).alias("mean_reading_ease"),
        "n",
        round_mean(band_distance("grade", low, high), 2).alias("dist_from_band"),
    )


def reading_level_by_model(responses: DataFrame, low: float, high: float) -> DataFrame:
    means = keyed(responses, ["model"]).groupBy("model").agg(
        round_mean(F.avg("response_fk_grade"), 2).alias("mean_response_fk_grade")
    )
    return means.withColumn("target_band", F.lit(f"{low}–{high}"))


def token_stats(responses: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each token count, the total, and how often reasoning is reported."""
    keys = ["model", *group]
    counts = keyed(responses, keys).select(
        *keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in TOKEN_COLUMNS]
    )
    columns = [F.count("*").alias("n")]
    for column, label in TOKEN_COLUMNS.items():
        columns.append(round_to(F.avg(column), 1).alias(f"{label}_mean"))
        columns.append(round_mean(F.coalesce(F.stddev_samp(column), F.lit(0.0)), 1).alias(f"{label}_sd"))
    columns.append(F.sum("total_tokens").alias("total_sum"))
    columns.append(
        round_to(F.avg((F.col("reasoning_tokens") > 0).cast("int")), 3).alias("reasoning_available_frac")
    )
    return counts.groupBy(*keys).agg(*columns)


def usage_stats(responses: DataFrame) -> DataFrame:
    def total(column: str):
        return F.coalesce(F.sum(column), F.lit(0)).alias("errors" if column == "is_error" else column)

    return responses.agg(
        F.count("*").alias("responses"),
        *[total(c) for c in ("total_tokens", "completion_tokens", "reasoning_tokens", "is_error")],
    )


def stage_progress(stages: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Done and expected rows per stage.

    Each stage gives two one-column, one-row tables: rows done and rows expected.
    """
    parts = []
    for number, (stage, (done, total)) in enumerate(stages.items()):
        one = done.toDF("done").withColumn("total", total.toDF("total").scalar())
        parts.append(one.select(F.lit(number).alias("step"), F.lit(stage).alias("stage"), "done", "total"))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    pct = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("done") / F.col("total"))).otherwise(F.lit(0.0))
    return table.withColumn("pct", round_to(pct, 4))
