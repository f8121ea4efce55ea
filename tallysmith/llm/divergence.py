"""How far sources of a language lie apart in their terms: exact divergences over a quadtree of the count matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.functions.numbers import as_column
from tallysmith.llm.shared import measured, small_batches
from tallysmith.operators.common import checkpointed

#: Only ASCII letters and characters beyond ASCII make a term.
TERM_BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that a task counts at a time.
PIECE = 16 << 20
#: Most rows of a table by language, level or group that is broadcast; more are joined by shuffling.
SMALL_ROWS = 100_000
UNIT = 1_000_000_000
#: Sides of the tiles that one task's group holds: groups of two sides of a pair, and about so many terms.
TILE_GROUPS, TILE_TERMS = 64, 256
#: Most (pair, term) nodes that a traversal holds at once.
FRONT = 1 << 20


def _tallied(rows: pa.Table) -> pa.RecordBatch:
    """(lang, source, term, n, d) of some rows: occurrences of each term in each group, and documents with it."""
    lang, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy()
    words = pc.split_pattern_regex(pc.ascii_lower(rows["text"].combine_chunks()), TERM_BREAK)
    doc = pc.list_parent_indices(words).to_numpy()
    flat = words.flatten().dictionary_encode()
    code, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    real = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[code] if len(names) else np.zeros(0, dtype=bool)
    code, doc = code[real], doc[real]
    size = max(len(names), 1)
    key, n = np.unique(group[doc] * size + code, return_counts=True)
    once = np.unique(doc * size + code)
    d = np.unique(group[once // size] * size + once % size, return_counts=True)[1]
    held = key // size
    return pa.record_batch(
        [
            lang.dictionary.take(pa.array(held // max(len(source.dictionary), 1))),
            source.dictionary.take(pa.array(held % max(len(source.dictionary), 1))),
            names.take(pa.array(key % size)), pa.array(n), pa.array(d),
        ],
        names=["lang", "source", "term", "n", "d"],
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's rows, in pieces of bounded size."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PIECE:
            yield _tallied(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield _tallied(pa.Table.from_batches(held))


def term_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by group, (lang, source, term, n); the kept terms, (lang, term, t, d, total) with a number t; and
    (lang, source) of every group that occurs.

    A term is kept in a language if at least ``least`` documents have it; d and total are its documents and
    occurrences there.  Tasks count before the shuffle, so a source with a third of all rows is a row a piece and term.
    """
    small_batches(docs.sparkSession)
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = checkpointed(named.select("lang", "source").distinct())
    met = named.mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    cells = checkpointed(met.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    kept = cells.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total")).filter(F.col("d") >= least)
    return cells.drop("d"), checkpointed(kept.withColumn("t", F.monotonically_increasing_id())), groups


def share(count: Column | str, size: Column | str, kinds: Column | str) -> Column:
    """1 + floor(UNIT * (count + 1) / (size + kinds)) in whole numbers; NULL without kinds of terms."""
    scaled = (as_column(count) + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = F.nullif(as_column(size) + as_column(kinds), F.lit(0)).cast("decimal(19,0)")
    return F.call_function("div", scaled, below) + 1


def gap(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so their squares fit a long."""
    step = as_column(p) - as_column(q)
    return F.call_function("div", step * step, as_column(q))


def quadrants(cells: np.ndarray) -> list[np.ndarray]:
    """Levels of the K^2-tree of a table with sides of equal powers of two: which quadrants hold a nonzero cell.

    Level 0 are the cells, each next level halves the sides, the last one is the root.
    """
    levels = [cells]
    while len(levels[-1]) > 1:
        half = len(levels[-1]) // 2
        levels.append(levels[-1].reshape(half, 2, half, 2).any(axis=(1, 3)))
    return levels


def traverse(filled: np.ndarray, shares: np.ndarray, paired: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gaps over the columns in which either row of a pair is filled, and the number of those columns.

    ``filled`` and ``shares`` are (rows, columns), ``paired`` (rows, rows).  Two nodes of the tree, one for each
    row of a pair, go down together; where both quadrants are all zero nothing below is looked at.
    """
    rows, columns = filled.shape
    side = 1 << max(rows - 1, columns - 1, 0).bit_length()
    cells = np.zeros((side, side), dtype=bool)
    cells[:rows, :columns] = filled
    levels = quadrants(cells)
    value, touched = np.zeros(rows * rows, dtype=np.int64), np.zeros(rows * rows, dtype=np.int64)
    root = np.zeros(1, dtype=np.int32)
    stack = [(len(levels) - 1, root, root, root)]
    while stack:
        level, a, b, c = stack.pop()
        full = levels[level][a, c] | levels[level][b, c]
        a, b, c = a[full], b[full], c[full]
        if level == 0:
            use = paired[a, b]
            a, b, c = a[use], b[use], c[use]
            p, q = shares[a, c], shares[b, c]
            pair = a.astype(np.int64) * rows + b
            np.add.at(value, pair, (p - q) ** 2 // q)
            touched += np.bincount(pair, minlength=rows * rows)
            continue
        a, b, c = ((x[:, None] * 2 + step).ravel() for x, step in ((a, _UPPER), (b, _MIDDLE), (c, _LOWER)))
        size = 1 << (level - 1)
        inside = (a * size < rows) & (b * size < rows) & (c * size < columns)
        a, b, c = a[inside], b[inside], c[inside]
        stack += [(level - 1, *(x[i : i + FRONT] for x in (a, b, c))) for i in range(0, len(a), FRONT)]
    return value.reshape(rows, rows), touched.reshape(rows, rows)


_UPPER, _MIDDLE, _LOWER = (np.array([(i >> s) & 1 for i in range(8)], dtype=np.int32)[None, :] for s in (2, 1, 0))
PAIRS = "g long, other long, value long, touched long"


def _tile(cells: pa.Table, heads: pa.Table) -> pa.Table:
    """Pairs of the groups of one tile, each both ways."""
    if not len(cells) or not len(heads):
        return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in PAIRS.split(", ")})
    head = heads.slice(0, 1).to_pylist()[0]
    left = [r["g"] for r in head["left_groups"]]
    base = {r["g"]: r["base"] for part in (head["left_groups"], head["right_groups"]) for r in part}
    names = np.array(sorted(base), dtype=np.int64)
    kinds, column = np.unique(cells["t"].to_numpy(), return_inverse=True)
    at = np.searchsorted(names, cells["g"].to_numpy())
    shares = np.repeat(np.array([base[n] for n in names.tolist()], dtype=np.int64)[:, None], len(kinds), axis=1)
    filled = np.zeros(shares.shape, dtype=bool)
    shares[at, column] = cells["p"].to_numpy()
    filled[at, column] = True
    one = np.isin(names, np.array(left, dtype=np.int64))
    # Both blocks of a tile may be one; else pairs of groups from one block belong to another tile.
    apart = one[:, None] != one[None, :] if head["left_block"] != head["right_block"] else ~np.eye(len(names), dtype=bool)
    value, touched = traverse(filled, shares, apart)
    a, b = np.nonzero(touched)
    return pa.table({"g": names[a], "other": names[b], "value": value[a, b], "touched": touched[a, b]})


def pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, other, value, touched): gaps over the terms that either of two groups has.

    The count matrix of a language is cut into tiles: blocks of groups by hash, blocks of terms by how many
    documents have them and hash, so that rare terms share tiles with large empty quadrants.  A tile's group holds
    at most two blocks of about ``TILE_GROUPS`` groups and about ``TILE_TERMS`` terms, whatever the input.
    """
    sides = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("side")
    dealt = (
        cells.select("lang", "level", "band", "g", "t", "p", "block", sides)
        .withColumn("left_block", F.least("block", "side"))
        .withColumn("right_block", F.greatest("block", "side"))
        .drop("block", "side")
    )
    key = ["lang", "level", "band", "left_block", "right_block"]
    lists = groups.groupBy("lang", "block").agg(F.collect_list(F.struct("g", "base")).alias("groups"))
    heads = dealt.select(*key).distinct()
    for side in ("left", "right"):
        named = lists.select("lang", F.col("block").alias(f"{side}_block"), F.col("groups").alias(f"{side}_groups"))
        heads = heads.join(named, ["lang", f"{side}_block"])
    heads = heads.select(*(F.col(c).alias(c) for c in heads.columns))  # columns of their own, apart from those of dealt
    parts = dealt.groupBy(*key).cogroup(heads.groupBy(*key)).applyInArrow(_tile, PAIRS)
    return parts.groupBy("g", "other").agg(F.sum("value").alias("value"), F.sum("touched").alias("touched"))


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others.

    Part ``pair``: for every other source of the language the sum over all kept terms of the gap between the two
    shares.  Terms that neither has all have one gap, priced at once; the rest comes from ``pair_sums``.  Part
    ``term``: the ``top`` terms that a source has more often than its language, by the gap to the language's share.

    NULL text, language and source read as ''; repeated rows count as often as they occur; a group without terms
    and a language without kept terms have their pairs (the latter with value 0); an empty table gives no rows;
    texts are read whole; other columns are not looked at.
    """
    counts, kept, named = term_counts(docs, least)
    level = F.floor(F.log2("d")).cast("int")
    kinds, _ = measured(kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("lang_size")), SMALL_ROWS)
    bands = kept.groupBy("lang", level.alias("level")).agg(F.ceil(F.count("*") / F.lit(TILE_TERMS)).alias("bands"))
    bands, _ = measured(bands, SMALL_ROWS)
    terms = kept.withColumn("level", level).join(bands, ["lang", "level"]).join(kinds, "lang").select(
        "lang", "term", "t", "level", F.pmod(F.xxhash64("term"), "bands").alias("band"),
        share("total", "lang_size", "kinds").alias("q"),
    )
    counted = checkpointed(counts.join(terms, ["lang", "term"]))
    sizes = counted.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    many = named.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(TILE_GROUPS)).alias("blocks"))
    groups = named.join(sizes, ["lang", "source"], "left").join(kinds, "lang", "left").join(many, "lang")
    groups = groups.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("size", "kinds")}).select(
        F.monotonically_increasing_id().alias("g"), "lang", "source", "size", "kinds", "blocks",
        share(F.lit(0), "size", "kinds").alias("base"), F.pmod(F.xxhash64("source"), "blocks").alias("block"),
    )
    groups, _ = measured(groups, SMALL_ROWS)
    cells = counted.join(groups.drop("base"), ["lang", "source"]).withColumn("p", share("n", "size", "kinds"))
    own = groups.select("g", "lang", "source", "kinds", "base")
    others = groups.select("lang", F.col("g").alias("other"), F.col("source").alias("item"), F.col("base").alias("other_base"))
    pairs = own.join(others, "lang").filter("g <> other").join(pair_sums(cells, groups), ["g", "other"], "left")
    rest = (F.col("kinds") - F.coalesce("touched", F.lit(0))) * gap("base", "other_base")
    value = F.coalesce(F.coalesce("value", F.lit(0)) + rest, F.lit(0)).alias("value")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = cells.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value")
    )
    leading = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(leading)
