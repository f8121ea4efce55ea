"""Folding human corrections back into the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysmith.functions.numbers import round_to, to_number, to_whole, truthy
from tallysmith.functions.text import fk_grade
from tallysmith.operators.common import first_per_key


def apply_overrides(trials: DataFrame, labels: DataFrame, rejected: DataFrame) -> DataFrame:
    """Replace scores by filled-in human scores and leave out rejected questions.

    ``labels``: model, question_id, run, human_score, position (a later position wins).
    ``rejected``: question_id, human_score of the reference answer; 0 removes the question.
    """
    filled = (
        labels.withColumn("human", to_whole("human_score"))
        .filter("human IS NOT NULL")
        .select("model", "question_id", "run", "human", "position")
    )
    latest = first_per_key(filled, ["model", "question_id", "run"], [-F.col("position")]).drop("position")
    wrong = rejected.filter(to_number("human_score") == 0).select("question_id")
    return (
        trials.join(wrong, "question_id", "left_anti")
        .join(latest, ["model", "question_id", "run"], "left")
        .withColumn("binary_score", F.coalesce("human", "binary_score"))
        .select(*trials.columns)
    )


def apply_edits(items: DataFrame, edits: DataFrame, remove_dropped: bool) -> DataFrame:
    """Apply a review sheet to the item table.

    ``edits``: question_id, question, reference_answer, keep, drop. The reading grade is computed again only
    where the question text changed. Dropped items are removed, or kept and marked ``dropped``.
    """
    sheet = edits.select(
        "question_id",
        F.col("question").alias("_question"),
        F.col("reference_answer").alias("_answer"),
        truthy("keep").alias("_keep"),
        truthy("drop").alias("_drop"),
        F.lit(True).alias("_edited"),
    )
    old_keep = truthy("keep") if "keep" in items.columns else F.lit(False)
    old_dropped = truthy("dropped") if "dropped" in items.columns else F.lit(False)
    joined = items.join(sheet, "question_id", "left")
    edited = F.coalesce("_edited", F.lit(False))
    new_question = edited & ~F.col("question").eqNullSafe(F.col("_question"))
    new_answer = edited & ~F.col("reference_answer").eqNullSafe(F.col("_answer"))
    dropped = F.coalesce("_drop", F.lit(False))
    grade = F.when(new_question, round_to(fk_grade("_question"), 2)).otherwise(F.col("fk_grade"))
    result = joined.select(
        *[c for c in items.columns if c not in ("question", "reference_answer", "fk_grade", "keep", "dropped")],
        F.when(new_question, F.col("_question")).otherwise(F.col("question")).alias("question"),
        F.when(new_answer, F.col("_answer")).otherwise(F.col("reference_answer")).alias("reference_answer"),
        grade.alias("fk_grade"),
        F.when(edited, F.col("_keep")).otherwise(old_keep).alias("keep"),
        (old_dropped | dropped).alias("dropped"),
        (new_question | new_answer).alias("changed"),
        dropped.alias("_gone"),
    )
    if remove_dropped:
        result = result.filter(~F.col("_gone"))
    return result.drop("_gone")
