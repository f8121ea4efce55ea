"""Small relational building blocks used by several operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


SPREAD_BYTES = 256 << 20
#: Input files behind one partition of rows that are sorted or grouped whole, and most partitions for that.
PART_BYTES, MOST_PARTS = 4 << 20, 10_000
#: Sizes from here on are Spark's word for unknown.
UNKNOWN_BYTES = 1 << 50
#: Spark's setting to delete the shuffle files of a query when it ends; off, they stay until the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose grouping keys are all present; missing keys take part in no report."""
    return df.dropna(how="any", subset=list(keys)) if keys else df


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order. Combines on the map side, so copies are cheap."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on a small input that comes in fewer splits than there are cores.

    An input of more than ``SPREAD_BYTES`` by the optimizer's estimate is never shuffled for that, however
    many cores there are: set the split size where it is read instead.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts_needed(df: DataFrame) -> int:
    """Partitions for rows that tasks hold in memory, in proportion to the files they are read from.

    0 where Spark's own exchange will do: an input of unknown size, or of no more than ``PART_BYTES`` a core.  Beyond
    that adaptive execution would merge partitions to one a core, whose memory grows with the input.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(size >= UNKNOWN_BYTES for size in sizes):
        return 0
    parts = -(-sum(sizes) // PART_BYTES)
    return min(parts, MOST_PARTS) if parts > df.sparkSession.sparkContext.defaultParallelism else 0


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tallysmith-")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries whose DataFrames are made inside delete their shuffle files as soon as they end.

    Jobs of many short steps would else keep the files of all steps on disk.  The session's own setting comes back.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def checkpointed(df: DataFrame, folders: Sequence[str] = ()) -> DataFrame:
    """Write the rows once as a table in the shared folder and go on from there.

    Like a reliable checkpoint, but the plan runs once only and later joins know the size of the table.  Filters on
    columns named in ``folders`` skip the files of other values.  Shuffle files of the plan go when the table is written.
    """
    path = f"{scratch_root(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.select("*").write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, hot: int = 1 << 20, width: int = 1 << 20,
    deal: Sequence[str] = (),
) -> DataFrame:
    """1, 2, ... per key in the given order; every row is numbered.

    A key with more than ``hot`` rows is cut into ranges of the first order column (an integer), which are
    numbered on their own and shifted by the rows of the earlier ranges.  Other keys, usually all, are one
    range.  The counts are combined before their shuffle; rows are shuffled once, by key.  A large input is counted
    first, and dealt to partitions in proportion to it.  ``deal`` names the keys to count and deal by, all if empty:
    a later join or grouping by these finds its rows in place.
    """
    deal = list(deal or keys)
    counted = df.groupBy(*deal).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot)
    parts = parts_needed(df)
    if parts:
        counted = checkpointed(counted)
        if counted.isEmpty():
            order_in_key = Window.partitionBy(*keys).orderBy(*order)
            rest = [c for c in df.columns if c not in keys]
            return df.repartition(parts, *deal).select(*keys, *rest, F.row_number().over(order_in_key).alias(name))
    marked = df.join(counted, deal, "left")
    cut = F.when(F.col("_rows").isNotNull(), F.floor(F.col(order[0]) / F.lit(width))).otherwise(F.lit(0))
    ranged = marked.withColumn("_piece", cut)
    sizes = ranged.filter("_rows IS NOT NULL").groupBy(*keys, "_piece").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_piece", F.sum("_size").over(before).alias("_start")).filter("_start > 0")
    local = Window.partitionBy(*keys, "_piece").orderBy(*order)
    dealt = ranged.repartition(parts, *keys, "_piece") if parts else ranged
    numbered = dealt.withColumn("_local", F.row_number().over(local)).join(starts, [*keys, "_piece"], "left")
    number = (F.col("_local") + F.coalesce("_start", F.lit(0))).cast("int")
    return numbered.withColumn(name, number).drop("_rows", "_piece", "_local", "_start")


def number_within(
    df: DataFrame, keys: Sequence[str], order: str, name: str, width: int = 1 << 20, starts: DataFrame | None = None
) -> DataFrame:
    """Sequential number per key along a unique integer column, without one task per key.

    Rows are cut into value ranges of ``width``; a range holds at most ``width`` rows of a key because the
    order is unique. Each range is numbered on its own and shifted by the rows of the earlier ranges, so a
    key holding a third of the table still spreads over many tasks. ``starts`` (keys, start) gives the first
    number of a key, 1 where it is missing; it is added to the small table of range sizes.
    """
    piece = df.withColumn("_piece", F.floor(F.col(order) / F.lit(width)))
    sizes = piece.groupBy(*keys, "_piece").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    if starts is not None:
        shifted = F.col("_offset") + F.coalesce("start", F.lit(1)) - 1
        offsets = offsets.join(starts, [*keys], "left").select(*keys, "_piece", shifted.alias("_offset"))
    local = Window.partitionBy(*keys, "_piece").orderBy(order)
    numbered = piece.withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(offsets, [*keys, "_piece"])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_piece", "_local", "_offset")
    )


def in_ranges(df: DataFrame, order: Sequence[Column], part: str = "_part") -> DataFrame:
    """The rows as a written table, range-partitioned by an order, with the number of their range in ``part``.

    Ranges follow each other in the order, so what runs over all rows can run within ranges and be carried on.
    """
    return checkpointed(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))


def carried(ranges: DataFrame, value: Column, merge: Callable[[Column, Column], Column], start: Column, name: str) -> DataFrame:
    """(_part, name): ``value`` of all earlier ranges merged, ``start`` for the first; a row per range.

    The values of the ranges, as many as there are partitions, are folded in one array.
    """
    listed = ranges.groupBy().agg(F.array_sort(F.collect_list(F.struct("_part", value.alias("v")))).alias("_all"))
    each = listed.select("_all", F.explode("_all").alias("_one"))
    before = F.filter("_all", lambda r: r["_part"] < F.col("_one._part"))
    return each.select(
        F.col("_one._part").alias("_part"), F.aggregate(before, start, lambda acc, r: merge(acc, r["v"])).alias(name)
    )
