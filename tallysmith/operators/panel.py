"""Judge panels: task lists, verdict tables, majority labels, automatic drops and review queues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysmith.functions.numbers import to_flag, to_number
from tallysmith.operators.common import first_per_key, keyed

DISAGREEMENT, UNANIMOUS_WRONG = "judge_disagreement", "unanimous_incorrect"


def judge_tasks(items: DataFrame, judges: Sequence[str]) -> DataFrame:
    """One task per item and judge."""
    return items.withColumn("judge", F.explode(F.array(*[F.lit(j) for j in judges])))


def run_tasks(items: DataFrame, runs: int) -> DataFrame:
    """One task per item and repetition, numbered from 1."""
    return items.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def pending(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks whose key is not done yet; keys of different types compare as text."""
    alike = {k: tasks.schema[k].dataType == done.schema[k].dataType for k in keys}

    def comparable(k: str) -> Column:
        return F.col(k) if alike[k] else F.col(k).cast("string")

    finished = done.select(*[comparable(k).alias(f"_{k}") for k in keys])
    return tasks.join(finished, [comparable(k) == F.col(f"_{k}") for k in keys], "left_anti")


def verdicts_wide(long: DataFrame, judges: Sequence[str], key: str = "question_id") -> DataFrame:
    """One row per item with a score and a rationale column per judge."""
    columns: list[Column] = []
    for j in judges:
        columns.append(F.max(F.when(F.col("judge") == j, F.col("score"))).alias(f"judge_{j}"))
    for j in judges:
        columns.append(F.max(F.when(F.col("judge") == j, F.col("rationale"))).alias(f"rationale_{j}"))
    return keyed(long, [key]).groupBy(key).agg(*columns)


def majority_label(judge_columns: Sequence[str]) -> Column:
    """1 when the verdicts reach half of the panel; a missing verdict counts as 0, a tie as 1."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in judge_columns), F.lit(0))
    return (total >= F.lit(len(judge_columns) / 2.0)).cast("int")


def disagreement(judge_columns: Sequence[str]) -> Column:
    """1 when two present verdicts differ."""
    cols = [F.col(c) for c in judge_columns]
    return F.coalesce((F.greatest(*cols) > F.least(*cols)).cast("int"), F.lit(0))


def with_labels(wide: DataFrame, judge_columns: Sequence[str]) -> DataFrame:
    return wide.withColumn("majority_label", majority_label(judge_columns)).withColumn(
        "human_review_flag", disagreement(judge_columns)
    )


def validated(items: DataFrame, long: DataFrame, judges: Sequence[str]) -> DataFrame:
    """Items with their verdict columns, majority label and disagreement flag."""
    wide = verdicts_wide(long, judges)
    return with_labels(items.join(wide, "question_id", "left"), [f"judge_{j}" for j in judges])


def doubted() -> Column:
    """Judges differ, or the panel rejects the reference answer."""
    return (F.col("human_review_flag") == 1) | (F.col("majority_label") == 0)


def drop_reason() -> Column:
    return F.when(F.col("human_review_flag") == 1, DISAGREEMENT).otherwise(UNANIMOUS_WRONG)


def auto_drop(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept items and the dropped ones with their reason."""
    dropped = labelled.filter(doubted()).withColumn("drop_reason", drop_reason()).drop("human_review_flag")
    return labelled.filter(~doubted()), dropped


def review_queue(labelled: DataFrame) -> DataFrame:
    """Items the judges differ on, with empty fields for a human."""
    return labelled.filter("human_review_flag = 1").withColumns(
        {"human_score": F.lit(None).cast("int"), "human_notes": F.lit(None).cast("string")}
    )


def lost_areas(labelled: DataFrame) -> DataFrame:
    """Areas in which every item is doubted, found in one aggregation."""
    counted = keyed(labelled, ["area"]).groupBy("area").agg(
        F.count("*").alias("n_items"), F.count_if(~doubted()).alias("kept")
    )
    return counted.filter("kept = 0").select("area", "n_items")


def all_judged(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """Every judged item: validated rows first, then automatically dropped ones."""
    both = kept.withColumn("_source", F.lit(0)).unionByName(
        dropped.withColumn("_source", F.lit(1)), allowMissingColumns=True
    )
    return first_per_key(both, ["question_id"], [F.col("_source")]).drop("_source")


def score_replies(
    tasks: DataFrame, gold: DataFrame, refused: Column, binary: Column, rubric: Column, why: Column,
    rubric_types: Sequence[str],
) -> DataFrame:
    """Long verdict rows; unknown questions and refusals score 0 without looking at the reply.

    ``tasks`` carries question_id, run, judge and whatever the given columns refer to; ``gold`` one row per
    question with its type.
    """
    known = gold.select("question_id", F.col("question_type").alias("_type"))
    joined = tasks.join(known, "question_id", "left")
    missing = F.col("_type").isNull()
    graded = F.coalesce(F.col("_type").isin(*rubric_types), F.lit(False))
    return joined.select(
        "question_id",
        "run",
        "judge",
        F.when(missing | refused, 0).otherwise(binary).alias("binary"),
        F.when(graded, F.when(refused, F.lit(0.0)).otherwise(rubric)).alias("rubric"),
        (missing | refused).cast("int").alias("is_refusal"),
        F.when(missing, "no gold row").when(refused, "refusal/empty/error").otherwise(why).alias("rationale"),
    )


def assemble_verdicts(
    responses: DataFrame, long: DataFrame, judges: Sequence[str], mode: str, keys: Sequence[str] = ("question_id", "run")
) -> DataFrame:
    """One row per response with the combined verdict.

    ``single`` adds the rationale, ``triple`` a column per judge and a flag when the judges differ. The
    verdicts are combined and spread into columns in one aggregation, so no join can multiply rows.
    """
    keys = list(keys)
    binary = to_number("binary")
    combined = [
        F.coalesce((F.avg(binary) >= 0.5).cast("int"), F.lit(0)).alias("binary_score"),
        F.avg(to_number("rubric")).alias("rubric_score"),
        F.max(to_flag("is_refusal")).alias("is_refusal"),
    ]
    if mode == "triple":
        differ = F.coalesce((F.max(binary) > F.min(binary)).cast("int"), F.lit(0))
        combined.append(differ.alias("human_review_flag"))
        for j in judges:
            combined.append(F.max(F.when(F.col("judge") == j, binary)).cast("int").alias(f"judge_{j}_binary"))
    elif mode == "single":
        combined.append(F.lit(0).alias("human_review_flag"))
        combined.append(F.max("rationale").alias("rationale"))
    else:
        raise ValueError(f"mode must be 'single' or 'triple', got {mode!r}")
    return responses.join(keyed(long, keys).groupBy(*keys).agg(*combined), keys, "left")


def verdict_columns(
    responses: DataFrame, judges: Sequence[str], keys: Sequence[str] = ("question_id", "run"), verdicts: str = "verdicts"
) -> DataFrame:
    """The ``judge_<judge>_binary`` columns of ``assemble_verdicts`` for responses that carry their verdicts.

    ``verdicts`` maps a judge to its binary verdict.  As with long rows, verdicts on a response with a missing key do
    not count.  Each response has its verdicts in its own row, so nothing is grouped, joined or shuffled.
    """
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    cells = {f"judge_{j}_binary": F.when(whole, to_number(F.col(verdicts)[j])).cast("int") for j in judges}
    return responses.withColumns(cells).drop(verdicts)
