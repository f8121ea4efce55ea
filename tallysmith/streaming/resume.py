"""Keyed, append-only result tables that a run can resume, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallysmith.operators.common import checkpointed, first_per_key
from tallysmith.operators.panel import pending
from tallysmith.sources.tables import backup, data_files, exists, recover, replace

#: A table is rewritten in larger files when it has more than this many, and they are smaller than this on average.
SMALL_FILES, SMALL_BYTES = 200, 32 << 20


class KeyedTable:
    """Append-only Parquet table with one row per key."""

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, fresh: bool = False,
        partition: Sequence[str] = (),
    ):
        """``partition`` names keys that split the table into folders; reading one of their values skips the others."""
        self.spark, self.path, self.keys, self.schema = spark, path, list(keys), schema
        self.partition = list(partition)
        if fresh:
            backup(spark, path)

    def read(self) -> DataFrame:
        recover(self.spark, self.path)
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.fieldNames())

    def pending(self, tasks: DataFrame) -> DataFrame:
        """Tasks that have no row yet."""
        return pending(tasks, self.read(), self.keys)

    def append(self, rows: DataFrame) -> None:
        """Add rows with new keys; of several rows with one key the smallest is taken."""
        self.add(pending(rows.select(*self.schema.fieldNames()), self.read(), self.keys))

    def add(self, rows: DataFrame) -> None:
        """Add rows whose keys are known to be new, without looking at the table."""
        names = self.schema.fieldNames()
        rest = [F.col(c) for c in names if c not in self.keys]
        rows = rows.select(*names)
        unique = first_per_key(rows, self.keys, rest).select(*names) if rest else rows.distinct()
        unique.write.mode("append").partitionBy(*self.partition).parquet(self.path)

    def fill(self, tasks: DataFrame, answer: Callable[[DataFrame], DataFrame], size: int) -> int:
        """Add ``answer(part)`` for parts of about ``size`` tasks, one after the other; returns the number of parts.

        What is stored stays if a later part fails, and the next run goes on with the rest.  The table is compared
        with the tasks once.  The open tasks are then written dealt out by a hash of their keys, a folder for each
        part, so a part reads its own rows only and all parts together read every task once.  Several tasks with
        one key are one.
        """
        given = [F.col(c) for c in tasks.columns if c not in self.keys]
        once = first_per_key(tasks, self.keys, given).select(*tasks.columns) if given else tasks.distinct()
        open_tasks = checkpointed(self.pending(once))
        parts = -(-open_tasks.count() // size)
        if parts == 0:
            return 0
        part = F.pmod(F.xxhash64(*self.keys), F.lit(parts)).cast("int")
        dealt = checkpointed(open_tasks.withColumn(PART, part).repartition(PART), [PART])
        for number in range(parts):
            self.add(answer(dealt.filter(F.col(PART) == number).drop(PART)))
        self.compact()
        return parts

    def compact(self, files: int = SMALL_FILES, small: int = SMALL_BYTES) -> bool:
        """Rewrite a table of many small files in larger ones; the old files are kept as a backup."""
        found, size = data_files(self.spark, self.path)
        if found <= files or size > found * small:
            return False
        rows = self.read().repartition(-(-size // (4 * small)), *[F.col(c) for c in self.partition or self.keys])
        replace(rows, self.path, self.partition)
        return True


#: Column that deals open tasks out.
PART = "_part"


def follow(rows: DataFrame, table: KeyedTable, checkpoint: str) -> int:
    """Append everything a streaming source offers now, once per key; returns the number of batches.

    A batch that is replayed after a failure finds its keys in the table and adds nothing.
    """
    query = (
        rows.writeStream.foreachBatch(lambda batch, _: table.append(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"] > 0)
