"""Rater agreement: panel reliability, pairwise agreement, pass rates and self-preference."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysmith.functions.numbers import round_mean, round_to, share
from tallysmith.functions.stats import fleiss_item_agreement, fleiss_kappa
from tallysmith.functions.text import percent_label
from tallysmith.operators.panel import disagreement


def panel_reliability(wide: DataFrame, judge_columns: Sequence[str], panel: Column) -> DataFrame:
    """Fleiss' kappa and raw agreement over fully judged items, flag rate over all items, per panel."""
    raters = F.lit(len(judge_columns))
    ones = sum((F.col(c) for c in judge_columns), F.lit(0))
    rows = wide.select(panel.alias("panel"), ones.alias("ones"), disagreement(judge_columns).alias("flag"))
    stats = rows.groupBy("panel").agg(
        F.count("ones").alias("n_items"),
        F.sum("ones").alias("total_ones"),
        F.avg(fleiss_item_agreement(F.col("ones"), raters)).alias("observed"),
        F.avg((F.col("ones") % raters == 0).cast("int")).alias("raw"),
        F.avg("flag").alias("flagged"),
    )
    kappa = fleiss_kappa(F.col("observed"), F.col("total_ones"), F.col("n_items"), raters)
    return stats.select(
        "panel",
        "n_items",
        raters.alias("n_judges"),
        round_mean(kappa, 3).alias("fleiss_kappa"),
        round_to("raw", 3).alias("raw_agreement"),
        round_to("flagged", 3).alias("flag_rate"),
    )


def _unstack(row: DataFrame, fields: Sequence[dict[str, Column]]) -> DataFrame:
    """One output row per dict of columns, from a single input row."""
    structs = [F.struct(*[c.alias(k) for k, c in f.items()]) for f in fields]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def pairwise_agreement(wide: DataFrame, judges: Sequence[str], prefix: str = "judge_") -> DataFrame:
    """Agreement percentage of every judge pair over the items both scored.

    All pairs are counted in one pass over the wide table; rows are never paired with rows.
    """
    pairs = list(combinations(judges, 2))
    counts: list[Column] = []
    for i, (a, b) in enumerate(pairs):
        ca, cb = F.col(prefix + a), F.col(prefix + b)
        counts.append(F.count_if(ca.isNotNull() & cb.isNotNull()).alias(f"n{i}"))
        counts.append(F.count_if(ca == cb).alias(f"same{i}"))
    fields = [
        {
            "judge A": F.lit(a),
            "judge B": F.lit(b),
            "percent": share(F.col(f"same{i}") * 100, F.col(f"n{i}")),
            "items": F.col(f"n{i}"),
        }
        for i, (a, b) in enumerate(pairs)
    ]
    table = _unstack(wide.agg(*counts), fields)
    return table.select("judge A", "judge B", round_to("percent", 1).alias("agree %"), "percent", "items")


def agreement_matrix(pairs: DataFrame, judges: Sequence[str]) -> DataFrame:
    """Symmetric judge x judge table of whole percentages, a dash on the diagonal."""
    ends = F.array(
        F.struct(F.col("judge A").alias("judge"), F.col("judge B").alias("other")),
        F.struct(F.col("judge B").alias("judge"), F.col("judge A").alias("other")),
    )
    both = pairs.select(F.explode(ends).alias("e"), percent_label(F.col("percent")).alias("label")).select(
        "e.*", "label"
    )
    hits = both.groupBy("judge").pivot("other", list(judges)).agg(F.max("label"))
    return hits.select(
        "judge", *[F.when(F.col("judge") == j, "—").otherwise(F.col(j)).alias(j) for j in judges]
    )


def pass_rates(wide: DataFrame, judges: Sequence[str], majority: str = "majority_label", prefix: str = "judge_") -> DataFrame:
    """Per judge: items scored, share scored correct, share equal to the panel majority."""
    counts: list[Column] = []
    for i, j in enumerate(judges):
        c = F.col(prefix + j)
        counts += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c == 1).alias(f"ones{i}"),
            F.count_if(c.isNotNull() & F.col(majority).isNotNull()).alias(f"both{i}"),
            F.count_if(c == F.col(majority)).alias(f"same{i}"),
        ]
    fields = [
        {
            "judge": F.lit(j),
            "items scored": F.col(f"n{i}"),
            "said correct %": round_to(share(F.col(f"ones{i}") * 100, F.col(f"n{i}")), 1),
            "agreed w/ majority %": round_to(share(F.col(f"same{i}") * 100, F.col(f"both{i}")), 1),
        }
        for i, j in enumerate(judges)
    ]
    return _unstack(wide.agg(*counts), fields)


def self_preference(verdicts: DataFrame, families: DataFrame) -> DataFrame:
    """Does a judge score answers of its own family higher?

    ``verdicts``: judge, model, binary. ``families``: model, family. Means are taken per (judge, model)
    first and then averaged over models; a name without a family counts as ``unknown``.
    """
    means = verdicts.groupBy("judge", "model").agg(F.avg("binary").alias("mean_binary"))
    of_model = families.select(F.col("model"), F.col("family").alias("model_family"))
    of_judge = families.select(F.col("model").alias("judge"), F.col("family").alias("judge_family"))
    joined = means.join(of_model, "model", "left").join(of_judge, "judge", "left")
    same = F.coalesce("model_family", F.lit("unknown")) == F.coalesce("judge_family", F.lit("unknown"))
    sides = joined.groupBy("judge").agg(
        F.avg(F.when(same, F.col("mean_binary"))).alias("same"),
        F.avg(F.when(~same, F.col("mean_binary"))).alias("other"),
    )
    return sides.select(
        "judge",
        round_mean("same", 4).alias("mean_score_same_family"),
        round_mean("other", 4).alias("mean_score_other_family"),
        round_mean(F.col("same") - F.col("other"), 4).alias("self_preference_delta"),
    )
