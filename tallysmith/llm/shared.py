"""Helpers that several text operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysmith.functions.numbers import as_column
from tallysmith.operators.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but ASCII digits, ASCII lower-case letters and non-ASCII characters separates words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000)
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def fold_ascii(text: Column | str) -> Column:
    """A-Z in lower case, other characters as they are. ``lower`` does that for pure ASCII, and much faster."""
    text = as_column(text)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column | str) -> Column:
    """Lower-cased words of a text in order; none for NULL."""
    return F.array_remove(F.split(fold_ascii(F.coalesce(as_column(text), F.lit(""))), WORD_BREAK), "")


def remainder(key: Column | str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; NULL for a NULL key."""
    return F.crc32(as_column(key).cast("string")) % modulus


def held_out(key: Column | str, modulus: int, rest: int) -> Column:
    return F.coalesce(remainder(key, modulus) == rest, F.lit(False))


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand whole texts to Python in small Arrow batches; smaller settings of the session stay.

    The usual batch of ten thousand rows takes several hundred megabytes of a worker where texts are long.
    """
    conf = spark.conf
    if int(conf.get(BATCH_ROWS[0])) > BATCH_ROWS[1]:
        conf.set(*map(str, BATCH_ROWS))
    given = re.match(r"(-?\d+)b?$", conf.get(BATCH_BYTES[0]))
    if given and not 0 < int(given[1]) <= BATCH_BYTES[1]:
        conf.set(*map(str, BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def measured(df: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The rows as a written table, with a broadcast hint only if they are counted to be at most ``most``.

    Beyond that the plan joins by shuffling.
    """
    table = checkpointed(df)
    rows = table.count()
    return (F.broadcast(table) if rows <= most else table), rows
