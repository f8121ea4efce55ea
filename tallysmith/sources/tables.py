"""Reading and writing evaluation tables: CSV for exchange, partitioned Parquet for volume."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, NumericType, StructType

from tallysmith.functions.numbers import to_number, to_whole


#: End of the name under which a table waits that is to replace another.
WAITING = "-next"


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Does the path, or any match of the glob, exist?"""
    target, fs = _path(spark, path)
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def _typed(raw: DataFrame, schema: StructType, extra: Sequence[Column] = ()) -> DataFrame:
    """Columns of the schema with junk numbers as NULL; absent columns become NULL."""
    columns = []
    for field in schema.fields:
        if field.name not in raw.columns:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, (IntegerType, LongType)):
            value = to_whole(F.col(f"`{field.name}`"), field.dataType.simpleString())
        elif isinstance(field.dataType, NumericType):
            value = to_number(F.col(f"`{field.name}`"))
        else:
            value = F.col(f"`{field.name}`").cast(field.dataType)
        columns.append(value.alias(field.name))
    return raw.select(*columns, *extra)


def _raw_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Text columns by header name. Quoted line breaks need ``multi_line``, which reads a file in one task;
    tables too large for that belong into Parquet."""
    return (
        spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"expected input {path} is missing; run the stage that writes it first")
    return _typed(_raw_csv(spark, path, multi_line), schema)


def read_csv_or_empty(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = True, required: Sequence[str] = ()
) -> DataFrame:
    """The file, if it is there; an error if it lacks a required column."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = _raw_csv(spark, path, multi_line)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(raw.columns)}")
    return _typed(raw, schema)


def read_per_model(
    spark: SparkSession, folder: str, suffix: str, schema: StructType, prefix: str = "", multi_line: bool = True
) -> DataFrame:
    """All files (or folders of part files) ``<prefix><model><suffix>.csv`` in one scan, the model from the name."""
    glob = f"{folder.rstrip('/')}/{prefix}*{suffix}.csv"
    if not exists(spark, glob):
        raise FileNotFoundError(f"no files match {glob}; run the stage that writes them first")
    # The name may be that of a file or of a folder of part files.
    pattern = f"/{re.escape(prefix)}([^/]*){re.escape(suffix)}\\.csv(/[^/]*)?$"
    raw = _raw_csv(spark, glob, multi_line)
    model = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("model")
    return _typed(raw, schema, [model])


def name_by_partition(spark: SparkSession, folder: str, column: str, prefix: str, suffix: str) -> None:
    """Give the folders that ``partitionBy(column)`` wrote the names ``<prefix><value><suffix>``, for exchange
    by file name."""
    root, fs = _path(spark, folder)
    for found in fs.listStatus(root):
        name = found.getPath().getName()
        if name.startswith(f"{column}="):
            fs.rename(found.getPath(), _path(spark, f"{prefix}{name.removeprefix(column + '=')}{suffix}")[0])


def read_trials(spark: SparkSession, folder: str, mode: str, schema: StructType, prefix: str = "") -> DataFrame:
    """Scored answers of a mode: missing scores and refusal marks count as 0, missing rubrics stay missing."""
    rows = read_per_model(spark, folder, f"_{mode}", schema, prefix)
    return rows.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("binary_score", "is_refusal")}
    )


def write_report(df: DataFrame, path: str) -> bool:
    """Overwrite a report as CSV with header; an empty report is not written."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = ("model",), mode: str = "overwrite") -> None:
    """Volume format: Parquet split by model (and mode), so that reading one model prunes the others."""
    df.write.mode(mode).partitionBy(*partitions).parquet(path)


def backup(spark: SparkSession, path: str) -> str | None:
    """Move an existing table into ``kept`` beside it, under the time of the move; nothing is deleted."""
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return None
    moment = datetime.now(timezone.utc).isoformat(timespec="microseconds").replace(":", "")
    folder, _ = _path(spark, f"{target.getParent().toString()}/kept/{target.getName()}")
    fs.mkdirs(folder)
    moved = f"{folder.toString()}/{moment[:-5]}"
    fs.rename(target, _path(spark, moved)[0])
    return moved


def backups(spark: SparkSession, path: str) -> int:
    """How many earlier tables ``backup`` has put aside for a path."""
    target, fs = _path(spark, path)
    folder, _ = _path(spark, f"{target.getParent().toString()}/kept/{target.getName()}")
    return len(fs.listStatus(folder)) if fs.exists(folder) else 0


def replace(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Put ``df``, which may read the table itself, in the place of a table; the old one is backed up.

    The new rows are written in full beside it first.  If the job ends between the two moves that follow, the table
    is missing and ``recover`` puts the new one in its place.
    """
    spark, waiting = df.sparkSession, f"{path}{WAITING}"
    df.write.mode("overwrite").partitionBy(*partitions).parquet(waiting)
    backup(spark, path)
    recover(spark, path)


def recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement that broke off after its rows were written; nothing to do otherwise."""
    target, fs = _path(spark, path)
    waiting, _ = _path(spark, f"{path}{WAITING}")
    if not fs.exists(target) and fs.exists(_path(spark, f"{path}{WAITING}/_SUCCESS")[0]):
        fs.rename(waiting, target)


def data_files(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of data files below ``path`` and their bytes."""
    target, fs = _path(spark, path)
    files, sizes = 0, 0
    if fs.exists(target):
        found = fs.listFiles(target, True)
        while found.hasNext():
            status = found.next()
            if not status.getPath().getName().startswith(("_", ".")):
                files, sizes = files + 1, sizes + status.getLen()
    return files, sizes


def model_subset(df: DataFrame, models: Sequence[str] | None) -> DataFrame:
    return df.filter(F.col("model").isin(*models)) if models else df
