"""Dataset coverage: quality audit, counts with totals, review selection and the reject funnel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.functions.numbers import in_band, round_mean, round_to, share
from tallysmith.functions.text import reject_bucket
from tallysmith.operators.common import checkpointed, keyed
from tallysmith.operators.ensemble import QUESTION_TYPES


def _type_counts(types: Sequence[str], names: Sequence[str] | None = None) -> list[Column]:
    names = names or list(types)
    return [F.count_if(F.col("question_type") == t).alias(n) for t, n in zip(types, names)]


def dataset_quality(
    items: DataFrame, standards: DataFrame, low: float, high: float, types: Sequence[str] = QUESTION_TYPES
) -> DataFrame:
    """Per area: item counts, standards covered, mean reading grade and share inside the band.

    Items are combined per (area, standard) first; areas without items show zeros.
    """
    names = [f"n_{t}" for t in types]
    cells = keyed(items, ["area", "standard"]).groupBy("area", "standard").agg(
        F.count("*").alias("n_questions"),
        *_type_counts(types, names),
        F.sum("fk_grade").alias("grade_sum"),
        F.count("fk_grade").alias("grade_n"),
        F.count_if(in_band("fk_grade", low, high)).alias("inside"),
    )
    sums = ["n_questions", *names, "grade_sum", "grade_n", "inside"]
    known = standards.select("area", "standard")
    every = known.join(cells, ["area", "standard"], "left")
    total = every.groupBy("area").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.count("*").alias("standards_total"),
        F.count("n_questions").alias("standards_covered"),
    )
    zero = F.lit(0)
    return total.select(
        "area",
        *[F.coalesce(c, zero).alias(c) for c in ["n_questions", *names]],
        "standards_total",
        "standards_covered",
        round_mean(F.coalesce(share(F.col("grade_sum"), F.col("grade_n")), F.lit(0.0)), 2).alias("mean_fk_grade"),
        round_to(F.coalesce(share(F.col("inside"), F.col("n_questions")), F.lit(0.0)), 3).alias("frac_in_band"),
    )


def quality_summary(quality: DataFrame) -> DataFrame:
    coverage = F.concat(
        F.min("standards_covered").cast("string"), F.lit("/"), F.max("standards_total").cast("string")
    )
    return quality.agg(
        F.sum("n_questions").alias("total_questions"),
        F.count_distinct("area").alias("areas"),
        coverage.alias("min_coverage"),
        round_mean(F.avg("frac_in_band"), 3).alias("mean_frac_in_band"),
    )


def quality_warnings(quality: DataFrame, quota: int) -> DataFrame:
    """Areas below the quota or with uncovered standards."""
    short = F.col("n_questions") < quota
    uncovered = F.col("standards_covered") < F.col("standards_total")
    return quality.filter(short | uncovered).select(
        "area",
        "n_questions",
        F.concat_ws("/", "standards_covered", "standards_total").alias("coverage"),
        short.cast("int").alias("below_quota"),
        uncovered.cast("int").alias("uncovered_standards"),
    )


def cell_counts(items: DataFrame, name: str = "n") -> DataFrame:
    keys = ["area", "standard", "question_type"]
    return keyed(items, keys).groupBy(*keys).agg(F.count("*").alias(name))


def coverage_rollup(items: DataFrame, standards: DataFrame, types: Sequence[str] = QUESTION_TYPES) -> DataFrame:
    """Counts per standard and type with area subtotals and a grand total; unused standards show zeros."""
    counts = keyed(items, ["area", "standard"]).groupBy("area", "standard").agg(*_type_counts(types))
    every = standards.select("area", "standard").join(counts, ["area", "standard"], "left")
    rolled = every.rollup("area", "standard").agg(
        *[F.coalesce(F.sum(F.col(f"`{t}`")), F.lit(0)).alias(t) for t in types],
        F.grouping_id().alias("level"),
    )
    total = sum((F.col(f"`{t}`") for t in types), F.lit(0))
    label = F.when(F.col("level") == 3, "Total").when(F.col("level") == 1, "Subtotal").otherwise(F.col("standard"))
    return rolled.select(
        F.when(F.col("level") == 3, "All areas").otherwise(F.col("area")).alias("area"),
        label.alias("standard"),
        *[F.col(f"`{t}`") for t in types],
        total.alias("total"),
    )


def composition(items: DataFrame, areas: DataFrame, types: Sequence[str] = QUESTION_TYPES) -> DataFrame:
    """Non-empty areas with counts and mean grade, and a TOTAL row adding the areas up."""
    per_cell = keyed(items, ["area"]).groupBy("area", "standard").agg(
        F.count("*").alias("questions"),
        *_type_counts(types),
        F.sum("fk_grade").alias("grade_sum"),
        F.count("fk_grade").alias("grade_n"),
    )
    per_area = per_cell.groupBy("area").agg(
        F.sum("questions").alias("questions"),
        F.count("standard").alias("standards"),
        *[F.sum(F.col(f"`{t}`")).alias(t) for t in types],
        round_mean(share(F.sum("grade_sum"), F.sum("grade_n")), 2).alias("mean FK"),
    )
    summed = ["questions", "standards", *types]
    rolled = per_area.rollup("area").agg(
        *[F.sum(F.col(f"`{c}`")).alias(c) for c in summed],
        F.when(F.grouping("area") == 0, F.max("mean FK")).alias("mean FK"),
        F.grouping("area").alias("is_total"),
    )
    titled = rolled.join(areas.select("area", F.col("area_title").alias("title")), "area", "left")
    last = F.col("is_total") == 1
    return titled.select(
        F.when(last, "TOTAL").otherwise(F.col("area")).alias("area"),
        F.when(last, "").otherwise(F.coalesce("title", F.lit(""))).alias("title"),
        *[F.col(f"`{c}`") for c in summed],
        F.col("`mean FK`"),
    )


def round_robin_selection(items: DataFrame, targets: Mapping[str, int], position: str) -> DataFrame:
    """Pick items per (area, type), cycling over standards in the order in which they first appear.

    No standard can give more than the target, so each standard is cut to its first items before the
    shuffle; the cycling itself then works on at most (standards x target) rows per area and type.
    """
    if not targets:
        raise ValueError("no targets given")
    most = max(targets.values())
    per_standard = Window.partitionBy("area", "question_type", "standard").orderBy(position)
    heads = (
        keyed(items, ["area", "question_type", "standard"])
        .filter(F.col("question_type").isin(*targets))
        .withColumn("_turn", F.row_number().over(per_standard))
        .filter(F.col("_turn") <= most)
    )
    first_seen = F.min(position).over(Window.partitionBy("area", "question_type", "standard"))
    cycle = Window.partitionBy("area", "question_type").orderBy("_turn", "_seen")
    target = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])[F.col("question_type")]
    return (
        heads.withColumn("_seen", first_seen)
        .withColumn("pick", F.row_number().over(cycle))
        .filter(F.col("pick") <= target)
        .drop("_turn", "_seen")
    )


def selection_pivot(selection: DataFrame, types: Sequence[str] = QUESTION_TYPES) -> DataFrame:
    """Selected items per standard, one column per type, with a total."""
    return selection.groupBy("area", "standard").agg(*_type_counts(types), F.count("*").alias("total"))


def reject_funnel(rejects: DataFrame) -> DataFrame:
    """Rejected candidates per readable reason."""
    bucket = rejects.select(reject_bucket("reason").alias("bucket"))
    return bucket.groupBy("bucket").agg(F.count("*").alias("rejected"))


#: Columns whose different values are counted.
COUNTED = ("model", "question_id", "area", "standard", "run")


def distinct_bitmaps(trials: DataFrame, by: Sequence[str] = (), counted: Sequence[str] = COUNTED) -> DataFrame:
    """(by, what, bucket, bits): which values of each counted column occur, as exact bitmaps that can be merged.

    Values are numbered once; a bitmap holds a bucket of 32 768 numbers.  Missing values are not counted.  Stored,
    the table answers any roll-up over ``by`` through ``distinct_counts``.
    """
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in counted]))
    met = trials.select(*by, values.alias("_v")).select(*by, "_v.*").filter("value IS NOT NULL").distinct()
    met = checkpointed(met)
    numbers = checkpointed(met.select("what", "value").distinct().withColumn("_n", F.monotonically_increasing_id()))
    # Both functions count from one.
    n = F.col("_n") + 1
    placed = met.join(numbers, ["what", "value"]).select(
        *by, "what", F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("_bit")
    )
    return placed.groupBy(*by, "what", "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def distinct_counts(bitmaps: DataFrame, by: Sequence[str] = (), counted: Sequence[str] = COUNTED) -> DataFrame:
    """n_<column> for each counted column in each group, from stored bitmaps; 0 where there are no values."""
    merged = bitmaps.groupBy(*by, "what", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    n = F.bitmap_count("bits")
    return merged.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("what") == c, n)), F.lit(0)).alias(f"n_{c}") for c in counted]
    )
