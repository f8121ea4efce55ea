"""Near copies by the Jaccard likeness of word shingles: a SimHash search and MinHash bands for candidates, whole texts to
verify."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysmith.llm.components import star_forest
from tallysmith.llm.shared import fresh, measured, small_batches
from tallysmith.llm.simhash import _FOLD, SEED, near_links, voted
from tallysmith.operators.common import checkpointed

SHINGLE = 5
LIKENESS = 0.8
#: Two texts of likeness s share one of the bands with probability 1 - (1 - s**ROWS)**BANDS: all but 3 pairs in
#: a million at 0.8, one in 13 at 0.3.
BANDS, ROWS = 32, 5
#: In a band with more nodes than this, pairs must also share one of finer bands: (1 - (1 - s**10)**64) is all but
#: seven pairs in ten thousand at 0.8, 32 in a hundred at 0.6, six at 0.5.
CROWD = 16
#: A finer band has 18 lanes: the first ten make its key, the lowest bits of all estimate a likeness.
FINE_BANDS, FINE_ROWS, FINE_KEYED = 64, 18, 10
FINE_LANES = FINE_BANDS * FINE_ROWS
#: Pairs that share fewer than this part of their lanes are not looked at: more than four standard deviations below
#: 0.8, which misses as few pairs of that likeness, some in a million, as the bands do.
LEAST_SHARED = 0.66
#: The same for the lowest bits of all finer lanes, whose estimate has a deviation of 0.018 at 0.8.
LEAST_SHARED_FINE = 0.73
#: Most row numbers that are broadcast; more are joined by shuffling.
ID_ROWS = 1_000_000
#: Values mixed at a time, which bounds the memory a very long text takes.
STEP = 1 << 19
LANES = BANDS * ROWS
_DRAWN = np.random.default_rng(SEED)
_MOST = max(LANES, FINE_LANES)
_FACTOR = _DRAWN.integers(0, 1 << 63, _MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAWN.integers(0, 1 << 63, _MOST, dtype=np.uint64)


def hashed(text: str | None, shingle: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """The joined words of a text in order, and the hashes of its shingles with repeats; one for a shorter text."""
    words = (text or "").encode("utf-8").translate(_FOLD).split()
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) < shingle:
        spans = [(0, len(joined))]
    else:
        spans = list(zip([0, *ends[:-1]], (e - 1 for e in ends[shingle - 1 :])))
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(spans))
    return joined, hashes


def shingles(text: str | None, shingle: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """A 128-bit digest of the words of a text, and the distinct hashes of its shingles."""
    joined, hashes = hashed(text, shingle)
    return xxhash.xxh3_128_digest(joined, SEED), np.unique(hashes)


def lanes(hashes: np.ndarray, count: int = LANES) -> np.ndarray:
    """The least values of so many random orders of the shingles."""
    least = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(STEP // count, 1)
    for at in range(0, len(hashes), step):
        mixed = hashes[at : at + step, None] * _FACTOR[:count] + _SHIFT[:count]
        np.minimum(least, (mixed >> np.uint64(16)).min(axis=0), out=least)
    return least


def bands(least: np.ndarray, rows: int = ROWS) -> list[int]:
    """A key for every band of so many lanes."""
    cut = least.reshape(-1, rows)
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), i)).astype(np.int64)) for i, r in enumerate(cut)]


def lanes_shared(a: Column, b: Column) -> Column:
    """Part of the lanes whose low bytes, eight to a number, are equal in two sketches."""
    one = F.lit(0x0101010101010101)
    differ = []
    for i in range(LANES // 8):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for step in (4, 2, 1):  # the lowest bit of a byte gathers its eight bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differ.append(F.bit_count(x.bitwiseAND(one)))
    return 1 - reduce(Column.__add__, differ) / F.lit(float(LANES))


def bits_shared(a: Column, b: Column) -> Column:
    """Estimated likeness from the lowest bits of the finer lanes: half of those of different values agree by chance."""
    differ = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(FINE_LANES // 64)]
    return 1 - reduce(Column.__add__, differ) * F.lit(2.0 / FINE_LANES)


def likeness(a: str | None, b: str | None, shingle: int = SHINGLE) -> float:
    one, two = shingles(a, shingle)[1], shingles(b, shingle)[1]
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared / (len(one) + len(two) - shared)


def _rooted(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the column root, the least node that the node is linked to, or itself; and as few links that do."""
    forest = star_forest(links)
    rows = rows.join(forest.select(F.col("u").alias("node"), F.col("v").alias("_to")), "node", "left")
    return checkpointed(rows.withColumn("root", F.coalesce("_to", "node")).drop("_to")), forest


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LIKENESS
) -> DataFrame:
    """One row of ``docs``, all columns, of each group: that with the smallest key, a NULL key last.

    A group is linked by texts whose distinct shingles of ``shingle`` words have a Jaccard likeness of ``least``
    or more.  Texts of the same words are one node from the start; texts without words are all the same.  Rows
    are known by a number of their own, so repeated and NULL keys do no harm.

    NULL and empty texts have no words; long texts are read whole, in pieces; an empty table stays empty; extra
    columns may have any name.

    The SimHash search of ``simhash.near_links`` comes first: links of its fingerprints (of the same shingles) are
    verified on whole texts.  A likeness of 0.8 mostly differs in more than its three bits, so what it has not
    linked is searched further: nodes that share a band are candidates.  They are first compared with the least node
    of one of their bands, then with a drawn node of each band, so a large group is joined up with a few comparisons
    a node.
    What is not in the main group of a band is then compared with all others there; in a crowded band only with
    those that share a finer band too, so texts that are somewhat alike are not all paired.  Of a pair the lanes
    are compared first, in this last step the bits of all finer lanes within the join; only if they leave 0.8
    possible, the link is verified on whole texts.
    """
    small_batches(docs.sparkSession)
    number, mark = fresh(docs, "_number"), fresh(docs, "_mark")

    @F.pandas_udf("digest binary, n int, keys array<long>, sketch array<long>, fp long")
    def marked(texts: pd.Series) -> pd.DataFrame:
        found = []
        for t in texts:
            joined, every = hashed(t, shingle)
            hashes = np.unique(every)
            own = lanes(hashes)
            sketch = np.frombuffer((own & np.uint64(255)).astype(np.uint8).tobytes(), dtype=np.int64)
            fp = voted(every) if joined else 0
            found.append((xxhash.xxh3_128_digest(joined, SEED), len(hashes), bands(own), sketch, fp))
        return pd.DataFrame(found, columns=["digest", "n", "keys", "sketch", "fp"])

    @F.pandas_udf("keys array<long>, bits array<long>")
    def finer(texts: pd.Series) -> pd.DataFrame:
        found = []
        for t in texts:
            own = lanes(shingles(t, shingle)[1], FINE_LANES)
            bits = np.packbits((own & np.uint64(1)).astype(np.uint8)).view(np.int64)
            found.append((bands(own.reshape(-1, FINE_ROWS)[:, :FINE_KEYED], FINE_KEYED), bits))
        return pd.DataFrame(found, columns=["keys", "bits"])

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y, shingle) for x, y in zip(a, b)], dtype="float64")

    rows = docs.withColumn(number, F.monotonically_increasing_id()).withColumn(mark, marked(F.col(text)))
    rows = checkpointed(rows)
    # The first row of each digest stands for all of them.
    nodes = checkpointed(rows.groupBy(F.col(mark)["digest"].alias("digest")).agg(F.min(number).alias("node")))
    own = rows.select(F.col(number).alias("node"), F.col(mark)["n"].alias("n"), F.col(mark)["keys"].alias("keys"))
    placed = own.join(nodes.select("node"), "node").select("node", "n", F.explode("keys").alias("band"))
    shared = checkpointed(placed)
    often = shared.groupBy("band").agg(F.count("*").alias("_c")).filter("_c > 1").select("band")
    shared = checkpointed(shared.join(often, "band", "left_semi").select("node", "n", "band"))
    texts = rows.select(F.col(number).alias("node"), F.col(text).alias("t"))
    sketches = rows.select(F.col(number).alias("node"), F.col(mark)["sketch"].alias("s"))
    fits = F.least("n", "m") >= F.greatest("n", "m") * F.lit(least)
    hopeful, hopeful_fine = (bound + least - LIKENESS for bound in (LEAST_SHARED, LEAST_SHARED_FINE))

    def met(pairs: DataFrame, side: DataFrame, name: str, test) -> DataFrame:
        """The pairs with a column of both ends that pass the test."""
        ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        asked = checkpointed(side.join(ends, "node", "left_semi"))
        both = pairs.join(asked.select(F.col("node").alias("u"), F.col(name).alias("a")), "u")
        both = both.join(asked.select(F.col("node").alias("v"), F.col(name).alias("b")), "v")
        return checkpointed(both.filter(test(both)).select("u", "v"))

    def verified(pairs: DataFrame) -> DataFrame:
        """(u, v) of the pairs that are alike enough."""
        pairs = checkpointed(pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct())
        return met(pairs, texts, "t", lambda both: alike("a", "b") >= least)

    def hoped(pairs: DataFrame) -> DataFrame:
        """The pairs whose lanes leave the likeness possible."""
        pairs = checkpointed(pairs.select(F.col("node").alias("u"), F.col("other").alias("v")).distinct())
        found = met(pairs, sketches, "s", lambda both: lanes_shared(F.col("a"), F.col("b")) >= hopeful)
        return found.select(F.col("u").alias("node"), F.col("v").alias("other"))

    def against(leader: DataFrame, rooted: DataFrame) -> DataFrame:
        """Members of a band with its leader, where they are not linked yet and the sizes allow it."""
        return rooted.join(leader, "band").filter((F.col("root") != F.col("other_root")) & fits).select("node", "other")

    def across(rooted: DataFrame) -> DataFrame:
        """Members of a band that are not in its main group with all others there that they are not linked to."""
        sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("_c"))
        main = sizes.groupBy("band").agg(F.max(F.struct("_c", "root"))["root"].alias("main"), F.count("*").alias("_roots"))
        mixed = checkpointed(rooted.join(main.filter("_roots > 1").drop("_roots"), "band").join(fine.select("node", "bits"), "node"))
        others = mixed.select(
            "band", F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("other_root"), F.col("bits").alias("other_bits")
        )
        apart = (F.col("root") != F.col("other_root")) & fits & (bits_shared(F.col("bits"), F.col("other_bits")) >= hopeful_fine)
        return mixed.filter("root <> main").join(others, "band").filter(apart).select("node", "other")

    printed = rows.select(F.col(number).alias("node"), F.col(mark)["fp"].alias("fp")).join(nodes.select("node"), "node")
    printed = checkpointed(printed)
    prints = checkpointed(printed.groupBy("fp").agg(F.min("node").alias("first")))
    ends = [prints.select(F.col("fp").alias(c), F.col("first").alias(n)) for c, n in (("u", "node"), ("v", "other"))]
    searched = near_links(prints.select("fp")).join(ends[0], "u").join(ends[1], "v").select("node", "other")
    alike_prints = printed.join(prints, "fp").filter("node <> first").select("node", F.col("first").alias("other"))
    links = verified(searched.union(alike_prints))
    rooted, links = _rooted(shared, links)
    head = F.min(F.struct("node", "n", "root")).alias("_l")
    lead = [F.col("_l.node").alias("other"), F.col("_l.n").alias("m"), F.col("_l.root").alias("other_root")]
    leaders = rooted.groupBy("band").agg(head).select("band", *lead)
    links = links.union(verified(hoped(against(leaders, rooted).groupBy("node").agg(F.min("other").alias("other")))))
    rooted, links = _rooted(shared, links)
    drawn = F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", "band")).alias("_l")
    leaders = rooted.groupBy("band").agg(drawn).select("band", *lead)
    links = links.union(verified(hoped(against(leaders, rooted))))
    rooted, links = _rooted(shared, links)
    counts = rooted.groupBy("band").agg(F.count("*").alias("_c"), F.min("root").alias("_a"), F.max("root").alias("_b"))
    counts = checkpointed(counts.filter("_a <> _b").select("band", "_c"))
    mixed = checkpointed(rooted.join(counts, "band"))
    fine = mixed.select("node").distinct().join(texts, "node").select("node", finer("t").alias("_f"))
    fine = checkpointed(fine.select("node", "_f.*"))
    few = across(mixed.filter(F.col("_c") <= CROWD).drop("_c"))
    crowded = mixed.filter(F.col("_c") > CROWD).select("node", "n", "root").distinct()
    cut = crowded.join(fine, "node").select("node", "n", "root", F.explode("keys").alias("band"))
    links = links.union(verified(few.union(across(checkpointed(cut)))))

    grouped, _ = _rooted(nodes.select("node"), links)
    placed = rows.select(F.col(number).alias("number"), F.col(key).alias("k"), F.col(mark)["digest"].alias("digest"))
    placed = checkpointed(placed.join(nodes.join(grouped, "node"), "digest"))
    order = F.struct(F.col("k").isNull().alias("a"), F.col("k").alias("b"), F.col("number").alias("c"))
    first = placed.groupBy("root").agg(F.min(order)["c"].alias("first"))
    gone = placed.join(first, "root").filter("number <> first").select(F.col("number").alias(number))
    gone, _ = measured(gone, ID_ROWS)
    return rows.join(gone, number, "left_anti").select(*docs.columns)
