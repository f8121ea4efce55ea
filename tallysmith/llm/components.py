"""Connected components of a link table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysmith.operators.common import checkpointed, shuffles_freed


def _with_least(links: DataFrame) -> DataFrame:
    """Each (u, v) with the least node next to u, or u itself."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.join(least, "u")


def _is_stars(links: DataFrame) -> bool:
    """No node has two links down, and none has links down and up."""
    one, none = F.lit(1), F.lit(0)
    ends = links.select(F.col("u").alias("node"), one.alias("down"), none.alias("up"))
    ends = ends.union(links.select("v", none, one))
    met = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    with shuffles_freed(links.sparkSession):
        return not met.agg(F.max((F.col("down") + F.col("up") > 1) & (F.col("down") > 0))).first()[0]


def star_forest(links: DataFrame) -> DataFrame:
    """(u, v): every linked node but the least of its component, with that one; see ``connected_components``."""
    ends = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = checkpointed(ends.distinct())
    while not _is_stars(current):
        near = _with_least(current)
        # Larger neighbours of every node move to its least neighbour ...
        large = near.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.filter("u <> v").distinct()
        # ... then the smaller neighbours, and the node, move to the least of those.
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        star = large.join(least, "u")
        small = star.select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            least.select("u", F.col("low").alias("v"))
        )
        current = checkpointed(small.filter("u <> v").distinct())
    return current


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node that has a link.

    ``links`` has long columns u and v; direction, loops, repeats and NULL ends do not matter (a row with a
    NULL end links nothing, a loop alone gives no row).  Alternating large-star and small-star steps keep the
    components and end in stars around the least nodes after a number of rounds logarithmic in practice.
    A hub is only ever grouped by a minimum (combined before the shuffle) and joined (split when skewed).
    Each round is a written table, so a lost executor costs one round at most; links that are stars already need none.
    """
    current = star_forest(links)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
