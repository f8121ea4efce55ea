"""Checking the judges against human labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.functions.numbers import round_mean, round_to, share, to_whole
from tallysmith.functions.stats import cohen_kappa
from tallysmith.operators.common import keyed, parts_needed

STRATA = ["source", "area", "question_type"]


def judge_columns(df: DataFrame, prefix: str = "judge_", suffix: str = "") -> list[str]:
    """Verdict columns by name; ``_binary`` columns only when asked for."""
    names = [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]
    return [c for c in names if suffix or not c.endswith("_binary")]


def judge_long(wide: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "judge_", suffix: str = "") -> DataFrame:
    """One row per item and judge from a table with a column per judge."""
    end = -len(suffix) if suffix else None
    named = wide.select(*keys, *[F.col(c).alias(c[len(prefix):end]) for c in columns])
    return named.unpivot(list(keys), [c[len(prefix):end] for c in columns], "judge", "llm_score")


def calibration_sheet(long: DataFrame, keys: Sequence[str], judges: Sequence[str]) -> DataFrame:
    """One row per item with an ``llm_<judge>`` column per judge; items with a missing key stay out.

    Items hardly repeat, so a large table is dealt out by item before it is grouped: no task holds more items than
    its part, neither before nor after the shuffle.
    """
    cells = [F.max(F.when(F.col("judge") == j, F.col("llm_score"))).alias(f"llm_{j}") for j in judges]
    rows, parts = keyed(long, keys), parts_needed(long)
    rows = rows.repartition(parts, *keys) if parts else rows
    return rows.groupBy(*keys).agg(*cells)


def stratified_sample(sheet: DataFrame, key: Sequence[str], per_cell: int, seed: int = 42, strata: Sequence[str] = STRATA) -> DataFrame:
    """Up to ``per_cell`` rows per stratum, picked by a seeded hash of the row key.

    The rank filter is pushed below the shuffle by Spark, so each task sends at most ``per_cell`` rows of a
    stratum, however large the stratum is.
    """
    pick = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    order = Window.partitionBy(*strata).orderBy("_pick", *key)
    return (
        keyed(sheet, strata)
        .withColumn("_pick", pick)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= per_cell)
        .drop("_rank", "_pick")
        .withColumns({"human_score": F.lit(None).cast("int"), "human_notes": F.lit(None).cast("string")})
    )


def judge_vs_human(sheet: DataFrame, judges: Sequence[str], prefix: str = "llm_") -> DataFrame:
    """Accuracy, kappa and error rates of each judge against the human label, per source and overall.

    The four agreement counts are taken per source; the overall rows add those counts up.
    """
    columns = [prefix + j for j in judges]
    named = sheet.select(
        "source",
        to_whole("human_score").alias("human"),
        *[to_whole(c).alias(c[len(prefix):]) for c in columns],
    )
    pairs = named.unpivot(["source", "human"], list(judges), "judge", "llm").filter(
        "human IS NOT NULL AND llm IS NOT NULL"
    )
    llm, human = F.col("llm"), F.col("human")
    cells = pairs.groupBy("source", "judge").agg(
        F.count_if((llm == 0) & (human == 0)).alias("n00"),
        F.count_if((llm == 0) & (human == 1)).alias("n01"),
        F.count_if((llm == 1) & (human == 0)).alias("n10"),
        F.count_if((llm == 1) & (human == 1)).alias("n11"),
    )
    names = ("n00", "n01", "n10", "n11")
    sets = [[F.col("source"), F.col("judge")], [F.col("judge")]]
    total = cells.groupingSets(sets, F.col("source"), F.col("judge")).agg(
        *[F.sum(c).alias(c) for c in names], F.grouping("source").alias("all_sources")
    )
    n00, n01, n10, n11 = (F.col(c) for c in names)
    n = n00 + n01 + n10 + n11
    return total.select(
        F.when(F.col("all_sources") == 1, "__all__").otherwise(F.col("source")).alias("source"),
        "judge",
        n.alias("n"),
        round_to(share(n00 + n11, n), 3).alias("accuracy"),
        round_mean(cohen_kappa(n00, n01, n10, n11), 3).alias("cohen_kappa"),
        round_to(share(n10, F.greatest(n00 + n10, F.lit(1))), 3).alias("false_correct_rate"),
        round_to(share(n01, F.greatest(n01 + n11, F.lit(1))), 3).alias("false_incorrect_rate"),
    )
