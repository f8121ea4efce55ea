"""First-run versus majority-vote accuracy, rankings, best picks and their wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.functions.numbers import round_to, share
from tallysmith.operators.accuracy import accuracy_table
from tallysmith.operators.common import keyed

QUESTION_TYPES = ("recall", "conceptual", "applied")


def majority(score: str = "binary_score") -> Column:
    """1 when at least half of the verdicts are 1."""
    return (F.avg(score) >= 0.5).cast("int")


VOTE_KEYS = ["model", "area", "standard", "question_type", "question_id"]


def votes(trials: DataFrame, keys: Sequence[str] = VOTE_KEYS) -> DataFrame:
    """One row per model and question: right answers and answers on run 1, and the majority vote.

    Rankings, best picks and significance all start from this table; several of them can share it.
    """
    first = F.col("run") == 1
    return keyed(trials, ["model", "question_id"]).groupBy(*keys).agg(
        F.sum(F.when(first, F.col("binary_score"))).alias("first_sum"),
        F.count(F.when(first, F.col("binary_score"))).alias("first_n"),
        majority().alias("vote"),
    )


def first_run_and_ensemble(trials: DataFrame, group: Sequence[str]) -> DataFrame:
    """Accuracy on run 1 and accuracy of the majority vote over runs, per (model, *group).

    ``trials`` may be the table of ``votes``.
    """
    keys = ["model", *group]
    per_item = trials if "vote" in trials.columns else votes(trials, [*keys, "question_id"])
    return keyed(per_item, keys).groupBy(*keys).agg(
        round_to(share(F.sum("first_sum"), F.sum("first_n")), 3).alias("first_run_accuracy"),
        round_to(share(F.sum("vote"), F.count("*")), 3).alias("ensemble_accuracy"),
        F.count("*").alias("n_questions"),
    )


def best_first() -> list[Column]:
    return [
        F.desc_nulls_last("ensemble_accuracy"),
        F.desc_nulls_last("first_run_accuracy"),
        F.col("model").asc(),
    ]


def rank_within(scores: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sequential rank inside each group; a group holds one row per model."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*best_first())))


def overall_ranking(trials: DataFrame) -> DataFrame:
    ranked = rank_within(first_run_and_ensemble(trials, []), [])
    gain = round_to(F.col("ensemble_accuracy") - F.col("first_run_accuracy"), 3)
    return ranked.select(
        "rank", "model", "first_run_accuracy", "ensemble_accuracy", gain.alias("ensemble_gain"), "n_questions"
    )


def ranking_by_area(trials: DataFrame, areas: DataFrame) -> DataFrame:
    """Models ranked inside each area, in the natural order of the areas (``areas.ordinal``)."""
    ranked = rank_within(first_run_and_ensemble(trials, ["area"]), ["area"])
    return ranked.join(areas.select("area", "area_title", "ordinal"), "area", "left").select(
        "area", "area_title", "ordinal", "rank", "model",
        "first_run_accuracy", "ensemble_accuracy", "n_questions",
    )


def ranking_by_standard(trials: DataFrame, standards: DataFrame) -> DataFrame:
    ranked = rank_within(first_run_and_ensemble(trials, ["standard"]), ["standard"])
    labels = standards.select("standard", "standard_text", "area", "ordinal")
    return ranked.join(labels, "standard", "left").select(
        "standard", "standard_text", "area", "ordinal", "rank", "model",
        "first_run_accuracy", "ensemble_accuracy", "n_questions",
    )


def best_pick(scores: DataFrame, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """Per group: every model tied at the top, the next tier, and the gap between both.

    Ties are ties of the rounded score. A group has one row per model, so its lists stay short.
    """
    tiers = scores.withColumn(
        "_tier", F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("ensemble_accuracy")))
    ).filter("_tier <= 2")

    def tier_models(tier: int) -> Column:
        members = F.array_sort(
            F.collect_list(
                F.when(
                    F.col("_tier") == tier,
                    F.struct(-F.coalesce("first_run_accuracy", F.lit(-1.0)), F.col("model").alias("model")),
                )
            )
        )
        names = F.array_join(F.transform(members, lambda m: m["model"]), ", ")
        return F.when(F.size(members) > 0, names)

    def tier_score(tier: int) -> Column:
        return F.max(F.when(F.col("_tier") == tier, F.col("ensemble_accuracy")))

    picked = tiers.groupBy(key).agg(
        *[F.min(c).alias(c) for c in carry],
        tier_models(1).alias("best_models"),
        F.count_if(F.col("_tier") == 1).alias("n_tied"),
        tier_score(1).alias("ensemble_accuracy"),
        tier_models(2).alias("runner_up_models"),
        tier_score(2).alias("runner_up_ensemble"),
    )
    return picked.withColumn("gap", round_to(F.col("ensemble_accuracy") - F.col("runner_up_ensemble"), 3))


def single_ensemble_pivot(scores: DataFrame, column: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per model (and extra keys) with a single and an ensemble column per value, in order."""
    cells = []
    for v in values:
        hit = F.col(column) == v
        cells.append(F.max(F.when(hit, F.col("first_run_accuracy"))).alias(f"{v} (single)"))
        cells.append(F.max(F.when(hit, F.col("ensemble_accuracy"))).alias(f"{v} (ens)"))
    return scores.groupBy(*keys, "model").agg(*cells)


def ensemble_matrix(scores: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Model x value matrix of ensemble accuracy."""
    return scores.groupBy("model").pivot(column, list(values)).agg(F.max("ensemble_accuracy"))


def stability(trials: DataFrame) -> DataFrame:
    """Run 1, majority vote, their difference and the spread of accuracy over the runs."""
    spread = accuracy_table(trials, []).select("model", "run_acc_std", "refusal_rate")
    return overall_ranking(trials).join(spread, "model", "left").select(
        "model",
        F.col("first_run_accuracy").alias("single"),
        F.col("ensemble_accuracy").alias("ensemble"),
        "ensemble_gain",
        "run_acc_std",
        "refusal_rate",
    )


def overall_table(trials: DataFrame, board: DataFrame) -> DataFrame:
    """Ranking by majority vote joined with leaderboard figures."""
    extra = ["macro_accuracy", "micro_accuracy", "refusal_rate", "mean_response_fk_grade", "mean_total_tokens"]
    present = [c for c in extra if c in board.columns]
    return overall_ranking(trials).join(board.select("model", *present), "model", "left").select(
        "rank",
        "model",
        F.col("first_run_accuracy").alias("single"),
        F.col("ensemble_accuracy").alias("ensemble"),
        "ensemble_gain",
        "n_questions",
        *present,
    )
