"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.llm.shared import SPACE_WORD, fresh, measured
from tallysmith.operators.common import checkpointed

REPEATS = 3
#: Rows of a source in one cell of keys, about; the cell that a target ends in is the only one sorted.
CELL_ROWS = 2_000
CELLS = 32
SOURCE_ROWS = 100_000


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def uniform(key: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the key alone, from 48 bits of its MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Adds target to (source, source_size, weight): shares of the total by weight, none above ``repeats``
    times its size; the excess goes to the others by weight until none is above.

    That fixed point is a water level: targets are least(cap, level * weight).  Ordered by cap per weight the
    sources that stop at their cap come first; the level follows from running sums.  One row per source.
    """
    cap = F.col("source_size") * repeats
    # A source without weight takes nothing and must not divide.
    rows = sizes.withColumn("_cap", cap.cast("double")).withColumn("_ratio", F.try_divide(F.col("_cap"), F.col("weight")))
    rows = rows.withColumn("_ratio", F.coalesce("_ratio", F.lit(float("inf"))))
    order = Window.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = F.try_divide(total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.sum("weight").over(after).cast("double"))
    rows = rows.withColumn("_level", level).withColumn("_open", F.col("_level") <= F.col("_ratio"))
    # The first source that the level does not fill marks the level of all that follow.
    common = F.min(F.when(F.col("_open"), F.struct("_ratio", F.col("source").isNull().alias("n"), "source", "_level")))
    level = common.over(Window.partitionBy())["_level"]
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("weight")))
    return rows.withColumn("target", target).select(*sizes.columns, "target")


def cycled_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds weight 1, 2, ... ``cycle``, 1, ... along the sources by code point, NULL last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", (F.row_number().over(order) - 1) % cycle + 1)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``mix_sized`` with sizes counted in words."""
    size = fresh(docs, "_size")
    return mix_sized(docs.withColumn(size, n_words(text)), key=key, size=size, source=source, **options)


def mix_sized(
    docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", size: str = "size",
    source: str = "source", quality: str | None = None, repeats: int = REPEATS, seed: int = 0,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``weights`` (source, weight) default to 1, 2, 3 in turn; a source that it lacks gets 0.
    A source takes complete epochs first; the fraction left goes to documents in the order of exponential keys
    -ln(u) / quality (Efraimidis and Spirakis: a weighted sample without replacement), summed until the target.
    The document in which the target falls is taken up to it, so a source meets its target to the word.

    ``quality`` names a column of positive weights; NULL, zero and negative ones count as 1.  u depends on
    the key alone, so runs agree; rows with equal keys are ordered by size, and rows equal in both are
    alike.  A NULL size counts as 0, and rows of size 0 are never taken; an empty table gives no rows.

    Key order is found without sorting a source in one task: keys fall into cells, cells are summed (combined
    before the shuffle), and rows are sorted in the one cell per source that the target falls in.
    """
    level = F.lit(1.0) if quality is None else F.coalesce(F.when(F.col(quality) > 0, F.col(quality)), F.lit(1.0))
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
        (-F.log(uniform(key, seed)) / level.cast("double")).alias("_key"),
    )
    rows = checkpointed(rows)
    sizes = checkpointed(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")))
    if weights is None:
        weighted = cycled_weights(sizes)
    else:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").alias("_weight"))
        weighted = sizes.join(given, sizes["source"].eqNullSafe(given["_source"]), "left")
        weighted = weighted.select(*sizes.columns, F.coalesce("_weight", F.lit(0)).alias("weight"))
    plan = targets(weighted, repeats)
    whole = F.rint("target").cast("long")
    epochs = F.coalesce(F.expr("CAST(rint(target) AS BIGINT) div nullif(source_size, 0)"), F.lit(0)).cast("long")
    plan = plan.withColumn("_epochs", F.when(F.col("source_size") > 0, epochs).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("_left", whole - F.col("_epochs") * F.col("source_size"))
    plan = plan.withColumn("_cells", F.greatest(F.lit(CELLS), F.ceil(F.col("_rows") / CELL_ROWS)))
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", "_epochs", "_left", "_cells")
    plan, _ = measured(plan, SOURCE_ROWS)
    # 1 - exp(-key) is in (0, 1) and grows with the key.
    share = F.lit(1.0) - F.exp(-F.col("_key"))
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["_source"]))
    placed = placed.withColumn("_cell", F.least(F.floor(share * F.col("_cells")), F.col("_cells") - 1))
    cells = placed.groupBy("source", "_cell").agg(F.sum("size").alias("_sum"), F.max("_left").alias("_goal"))
    order = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_sum").over(order), F.lit(0)))
    border = cells.filter((F.col("_before") < F.col("_goal")) & (F.col("_before") + F.col("_sum") >= F.col("_goal")))
    border = border.select(F.col("source").alias("_at"), F.col("_cell").alias("_border"), "_before")
    border, _ = measured(border, SOURCE_ROWS)
    found = placed.join(border, placed["source"].eqNullSafe(border["_at"]), "left")
    at = F.col("_cell") == F.col("_border")
    inside = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    hit = found.filter(at)
    hit = hit.withColumn("_reached", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("_reached")))
    hit = hit.withColumn("_part", part.cast("long"))
    rest = found.filter(~F.coalesce(at, F.lit(False)))
    rest = rest.withColumn("_part", F.when(F.col("_cell") < F.col("_border"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    taken = (F.col("_epochs") * F.col("size") + F.col("_part")).alias("taken")
    return hit.select(*columns, taken).unionByName(rest.select(*columns, taken))
