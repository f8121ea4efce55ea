"""Removal of repeated line runs by winnowing over line hashes. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysmith.functions.numbers import bind
from tallysmith.llm.shared import SPACE_WORD, fresh
from tallysmith.operators.common import checkpointed

#: Runs of so many lines are always found ...
RUN = 2
#: ... and so are single lines of so many words.
LONG = 50


def _selected(hashes: Column, big: Column, run: int) -> Column:
    """1-based positions of the fingerprints: minima of all windows of ``run`` lines, and long lines."""

    def choose(h: Column) -> Column:
        count = F.size(h)
        starts = F.when(count >= run, F.sequence(F.lit(1), count - run + 1)).otherwise(F.array().cast("array<int>"))
        minima = F.transform(starts, lambda s: F.array_min(F.slice(h, s, run)))

        def pick(m: Column) -> Column:
            places = F.when(count >= run, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
            lowest = lambda i: F.greatest(F.lit(1), i - run + 1)
            return F.filter(
                places, lambda i: F.array_contains(F.slice(m, lowest(i), i - lowest(i) + 1), F.element_at(h, i))
            )

        every = F.sequence(F.lit(1), count)
        return F.array_union(bind(minima, pick), F.filter(every, lambda i: F.element_at(big, i)))

    return bind(hashes, choose)


def repeated_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, long: int = LONG
) -> DataFrame:
    """(_id, doc_key, start, size): runs of lines to delete because they occurred before.

    _id is the key and doc_key stands for key and text; see ``dedupe_lines``.  Steps: the least line hash of every window of
    ``run`` lines is a fingerprint, so any two equal runs share one; fingerprints that occur more than once
    are joined to their positions; every run of ``run`` lines through such a position (the match, extended
    both ways) is compared by its own 128-bit key with the first such run of the corpus in the order of
    (key, position).
    """
    line = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n")
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    rows = rows.select("_id", F.xxhash64("_id", "_text").alias("doc_key"), line.alias("_lines"))
    rows = rows.select(
        "_id", "doc_key",
        F.transform("_lines", lambda x: F.xxhash64(x)).alias("_h"),
        F.transform("_lines", lambda x: F.xxhash64(F.lit(1), x)).alias("_g"),
        F.transform("_lines", lambda x: F.regexp_count(x, F.lit(SPACE_WORD)) >= long).alias("_big"),
    )

    def mark(at: Column) -> Column:
        """A fingerprint with the lines around it that a run through it can have."""
        low = F.greatest(F.lit(1), at - run + 1)
        span = F.least(F.size("_h"), at + run - 1) - low + 1
        return F.struct(
            at.alias("_pos"), low.alias("_low"), F.element_at("_h", at).alias("_mark"),
            F.slice("_h", low, span).alias("_h"), F.slice("_g", low, span).alias("_g"),
            F.element_at("_big", at).alias("_long"),
        )

    # Marks are cut out before they are exploded: a row never carries the lines of its whole text.
    found = F.explode(F.transform(_selected(F.col("_h"), F.col("_big"), run), mark)).alias("m")
    marks = checkpointed(rows.select("_id", "doc_key", found).select("_id", "doc_key", "m.*"))
    often = marks.groupBy("_mark").agg(F.count("*").alias("_n")).filter("_n > 1").select("_mark")
    met = marks.join(often, "_mark", "left_semi")

    def piece(name: str, at: Column, size: Column | int) -> Column:
        return F.slice(name, at, size)

    def coded(at: Column, size: Column | int) -> Column:
        start = (F.col("_low") + at - 1).alias("start")
        return F.struct(
            start, F.lit(size).cast("int").alias("size"),
            F.xxhash64(piece("_h", at, size)).alias("k1"), F.xxhash64(piece("_g", at, size)).alias("k2"),
        )

    kind = "array<struct<start:int,size:int,k1:bigint,k2:bigint>>"
    starts = F.sequence(F.lit(1), F.size("_h") - run + 1)
    written = F.filter(starts, lambda s: F.exists(piece("_h", s, run), lambda h: h != F.xxhash64(F.lit(""))))
    many = F.when(F.size("_h") >= run, F.transform(written, lambda s: coded(s, run)))
    one = F.when(F.col("_long"), F.array(coded(F.col("_pos") - F.col("_low") + 1, 1)))
    empty = F.array().cast(kind)
    runs = met.select(
        "_id", "doc_key", F.explode(F.concat(F.coalesce(many.cast(kind), empty), F.coalesce(one.cast(kind), empty))).alias("r")
    )
    runs = checkpointed(runs.select("_id", "doc_key", "r.*").distinct())
    place = F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("doc_key").alias("c"), F.col("start").alias("d"))
    first = runs.groupBy("size", "k1", "k2").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    later = runs.join(first.filter("_n > 1"), ["size", "k1", "k2"]).filter(place > F.col("_first"))
    return later.select("_id", "doc_key", "start", "size")


def dedupe_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, long: int = LONG
) -> DataFrame:
    """All rows and columns of ``docs`` with the text less its repeated runs, plus n_lines, n_removed
    (columns of those names are replaced).

    A run of ``run`` or more lines, or a line of ``long`` or more words, that occurred before (an earlier key,
    or further up in the same text) is deleted; the first occurrence stays.  Runs of blank lines do not count.  A run may overlap its first
    occurrence, so of a periodic stretch the first period stays.  Lines end at "\\n" and are compared as they
    are.  A document whose lines all go keeps its row with an empty text; NULL texts stay NULL with no lines;
    NULL keys come last.  Rows that repeat both key and text count as one document and get one result.
    """
    own, other, dropped, same = (fresh(docs, c) for c in ("_key", "_doc_key", "_gone", "_same_id"))
    base = docs.withColumn(own, F.xxhash64(F.col(key), F.col(text)))
    gone = repeated_runs(docs, key, text, run, long)
    gone = gone.groupBy("_id", "doc_key").agg(F.collect_set(F.struct("start", "size")).alias("_runs"))
    gone = gone.select(
        F.col("_id").alias(same), F.col("doc_key").alias(other),
        F.array_distinct(
            F.flatten(F.transform("_runs", lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1)))
        ).alias(dropped),
    )
    joined = base.join(gone, (base[own] == gone[other]) & base[key].eqNullSafe(gone[same]), "left")
    lines = F.split(F.col(text), "\n")
    left = bind(
        lines,
        lambda every: F.transform(
            F.array_except(F.sequence(F.lit(1), F.size(every)), F.col(dropped)), lambda i: F.element_at(every, i)
        ),
    )
    kept = F.when(F.col(dropped).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    count = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    count = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(count)
    return joined.select(
        *[F.col(c) for c in docs.columns if c not in (text, "n_lines", "n_removed")],
        kept.alias(text), count.alias("n_lines"),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_removed"),
    )
