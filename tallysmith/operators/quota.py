"""Question quotas: planning, open need, redistribution of stuck slots and id allocation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.operators.common import keyed, number_within

SLOT = ["area", "standard", "question_type"]


def quota_plan(standards: DataFrame, split: Mapping[str, int]) -> DataFrame:
    """Target per slot: each type's quota spread over the standards of an area, remainder to the first ones.

    ``standards`` is the dimension (area, standard, ordinal), so the windows see one row per standard.
    """
    by_area = Window.partitionBy("area")
    place = F.row_number().over(by_area.orderBy("ordinal")) - 1
    size = F.count("*").over(by_area)
    quotas = F.array(
        *[F.struct(F.lit(t).alias("question_type"), F.lit(n).alias("quota")) for t, n in split.items()]
    )
    slots = standards.select("area", "standard", "ordinal", place.alias("place"), size.alias("size"))
    rows = slots.withColumn("q", F.explode(quotas)).select("*", "q.*")
    extra = (F.col("place") < F.col("quota") % F.col("size")).cast("int")
    target = F.floor(F.col("quota") / F.col("size")) + extra
    return rows.select("area", "standard", "question_type", "ordinal", target.cast("bigint").alias("target"))


def slot_need(plan: DataFrame, items: DataFrame) -> DataFrame:
    """Plan with the accepted items and what is still missing per slot."""
    have = keyed(items, SLOT).groupBy(*SLOT).agg(F.count("*").alias("have"))
    filled = plan.join(have, SLOT, "left").withColumn("have", F.coalesce("have", F.lit(0).cast("bigint")))
    return filled.withColumn("need", F.col("target") - F.col("have"))


def redistribute(slots: DataFrame) -> DataFrame:
    """Cap each stuck slot at what it has and hand its need to the open sibling standards.

    ``slots``: slot keys, ordinal, target, have, stuck, capped. Stuck slots give in order and round-robin, so
    a slot may first receive and then give. One (area, type) holds as many slots as the area has standards,
    which is a fixed dimension; its slots are folded as one short array.
    """
    fields = ["ordinal", "standard", "target", "have", "stuck", "capped"]
    packed = slots.groupBy("area", "question_type").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("slots")
    )

    def give(state: Column, i: Column) -> Column:
        giver = F.element_at(state, i + 1)
        shortfall = F.greatest(giver["target"] - giver["have"], F.lit(0))
        ranked = F.transform(
            state,
            lambda s, j: F.struct(
                (~s["capped"] & (j != i)).alias("open"), s.alias("slot"), j.alias("place")
            ),
        )
        n_open = F.size(F.filter(ranked, lambda r: r["open"]))

        def step(row: Column) -> Column:
            s = row["slot"]
            before = F.size(F.filter(ranked, lambda r: r["open"] & (r["place"] < row["place"])))
            gain = F.floor(F.try_divide(shortfall, n_open)) + (before < shortfall % F.nullif(n_open, F.lit(0))).cast("int")
            target = (
                F.when(row["place"] == i, s["have"])
                .when(row["open"], s["target"] + gain)
                .otherwise(s["target"])
            )
            return F.struct(
                s["ordinal"].alias("ordinal"),
                s["standard"].alias("standard"),
                target.cast("bigint").alias("target"),
                s["have"].alias("have"),
                s["stuck"].alias("stuck"),
                (s["capped"] | (row["place"] == i)).alias("capped"),
            )

        return F.when(giver["stuck"] & ~giver["capped"], F.transform(ranked, step)).otherwise(state)

    places = F.sequence(F.lit(0), F.size("slots") - 1)
    done = packed.withColumn("slots", F.aggregate(places, F.col("slots"), give))
    return done.select("area", "question_type", F.inline("slots")).select(
        *SLOT, "ordinal", "target", "have", "capped", (F.col("target") - F.col("have")).alias("need")
    )


def next_numbers(existing: DataFrame) -> DataFrame:
    """First free number per area, one above the highest id suffix."""
    suffix = F.regexp_extract("question_id", r"(\d+)$", 1).try_cast("bigint")
    return keyed(existing, ["area"]).groupBy("area").agg(
        (F.coalesce(F.max(suffix), F.lit(0)) + 1).alias("next_number")
    )


def allocate_ids(new: DataFrame, existing: DataFrame, position: str, width: int = 1 << 20) -> DataFrame:
    """Give new items ids that go on after the highest one of their area, in ``position`` order."""
    starts = next_numbers(existing).withColumnRenamed("next_number", "start")
    numbered = number_within(new, ["area"], position, "_n", width, starts)
    number = F.col("_n")
    padded = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    return numbered.withColumn("question_id", F.concat("area", F.lit("-"), padded)).drop("_n")


def areas_below_quota(need: DataFrame, quota: int) -> DataFrame:
    """Areas that hold fewer accepted items than the quota."""
    return need.groupBy("area").agg(F.sum("have").alias("have")).filter(F.col("have") < quota)
