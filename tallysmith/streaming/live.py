"""Running totals over append-only tables: only files that came since the last look are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallysmith.sources.tables import exists


def follow_totals(rows: DataFrame, keys: Sequence[str], sums: Sequence[str], path: str, checkpoint: str) -> int:
    """Bring the totals under ``path`` up to date with a streaming source; returns the number of batches that had rows.

    Spark keeps rows and sums of each key as state; a batch writes the new totals of the keys it changed, in a folder
    of its own that a replay of the batch overwrites.
    """
    totals = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    )

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        totals.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"] > 0)


def latest_totals(spark: SparkSession, keys: Sequence[str], path: str, schema: StructType) -> DataFrame:
    """The newest totals of every key; no rows before the first batch. ``schema`` names keys and totals."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    names = [f.name for f in schema.fields if f.name not in keys]
    found = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(path)
    newest = F.max_by(F.struct(*names), "batch").alias("_t")
    return found.groupBy(*keys).agg(newest).select(*keys, "_t.*")
