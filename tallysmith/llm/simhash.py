"""SimHash fingerprints of word shingles and an exact Hamming search by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysmith.llm.components import connected_components
from tallysmith.llm.shared import fresh, measured, small_batches
from tallysmith.operators.common import checkpointed, shuffles_freed

BITS = 64
SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Keys that a fingerprint is written under for one part at most.
MOST_KEYS = 1_000
#: Rows of one bucket that are compared in one go; larger buckets are cut into blocks.
BLOCK = 4096
#: Most ids that are broadcast; more are joined by shuffling.
ID_ROWS = 1_000_000
#: Shingles hashed at a time, which bounds the memory a very long text takes.
STEP = 1 << 15
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- fingerprints -----------------------------------------------------------------------------------------

def _votes(hashes) -> np.ndarray:
    """How many of the hashes have each bit set."""
    bits = np.unpackbits(np.asarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _chosen(votes: np.ndarray, count: int) -> int:
    return int(np.packbits(votes * 2 > count, bitorder="little").view("<i8")[0])


def voted(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, repeats included: a bit is set where over half of them have it set."""
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), STEP):
        votes += _votes(hashes[at : at + STEP])
    return _chosen(votes, len(hashes))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: bit set where over half of the shingle hashes have it set; 0 without words."""
    words = (text or "").encode("utf-8").translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    if len(words) < shingle:
        spans = [(0, len(joined))]
    else:
        spans = list(zip(starts, (e - 1 for e in ends[shingle - 1 :])))
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(spans), STEP):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans[at : at + STEP]]
        votes += _votes(hashes)
    return _chosen(votes, len(spans))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; repeated rows and NULL keys stay as they are. No shuffle."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), _printed(shingle)(F.col(text)).alias("fp"))


def _printed(shingle: int):
    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash(t, shingle) for t in texts), dtype=np.int64, count=len(texts)))

    return printed


# --- plan of the search -----------------------------------------------------------------------------------

def _collected(few: DataFrame) -> list:
    with shuffles_freed(few.sparkSession):
        return few.select("*").collect()


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often two bits are set together, over all of them."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        together, rows = np.zeros((BITS, BITS)), 0
        for frame in frames:
            raw = frame["fp"].to_numpy(dtype="<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            together += bits.T @ bits
            rows += len(frame)
        cells = np.append(together.ravel(), rows).astype(np.int64)
        yield pd.DataFrame({"cell": np.arange(cells.size), "n": cells})

    sums = prints.select("fp").mapInPandas(batches, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(BITS * BITS + 1)
    for row in _collected(sums):  # 4097 rows whatever the input
        cells[row["cell"]] = row["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(rows: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size, each grown by the bit that correlates most with the group."""
    rows = max(rows, 1)
    mean = np.diag(together) / rows
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    corr = np.abs((together / rows - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        # The free bit that is tied most to other free bits starts the group.
        order = sorted(free)
        group = [max(order, key=lambda b: (corr[b, order].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            order = sorted(free)
            best = max(order, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def _distance_odds(mean: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Chance that two fingerprints differ in 0..most of the bits, were the bits independent."""
    odds = [1.0] + [0.0] * most
    for b in bits:
        differ = 2 * mean[b] * (1 - mean[b])
        odds = [odds[d] * (1 - differ) + (odds[d - 1] * differ if d else 0.0) for d in range(most + 1)]
    return odds


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds that add up to ``total`` at the least cost; ``costs[i][t + 1]`` is part i's at threshold t."""
    best = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, len(part) - 1):
                new = (cost + part[t + 1], [*chosen, t])
                if spent + t not in step or new < step[spent + t]:
                    step[spent + t] = new
        best = step
    return best[total]


def search_plan(prints: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe; a part of threshold -1 is left out.

    If two fingerprints differ in at most ``distance`` bits, then for thresholds adding up to
    ``distance - parts + 1`` some part differs in no more than its threshold.  For each number of parts the
    thresholds come from dynamic programming over estimated work: keys written plus candidates met, where
    candidates at distance 0 are counted exactly over all fingerprints and farther ones follow from the bits'
    frequencies.
    """
    rows, together = bit_counts(prints)
    mean = np.diag(together) / max(rows, 1)
    options = []
    for parts in range(1, distance + 2):
        groups = group_bits(rows, together, parts)
        equal = _equal_pairs(prints, groups)
        total = distance - parts + 1
        costs = []
        for bits, pairs in zip(groups, equal):
            odds = _distance_odds(mean, bits, max(total + parts - 1, 0))
            line = [0.0]
            for t in range(0, total + parts):
                each = sum(comb(len(bits), d) for d in range(t + 1))
                if each > MOST_KEYS:  # never needed: with more parts smaller thresholds do
                    break
                keys = (rows + 1) * each
                met = pairs * sum(odds[: t + 1]) / max(odds[0], 1e-30)
                line.append(8.0 * keys + met)
            costs.append(line)
        if total <= sum(len(line) - 2 for line in costs):
            cost, thresholds = allocate(costs, total)
            options.append((cost, [(bits, t) for bits, t in zip(groups, thresholds) if t >= 0]))
    return min(options)[1]


def _masked(fp, bits: list[int]):
    mask = sum(1 << b for b in bits)
    return F.col(fp).bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask))


def _equal_pairs(prints: DataFrame, groups: list[list[int]]) -> list[float]:
    keys = F.array(*[F.struct(F.lit(i).alias("part"), _masked("fp", g).alias("key")) for i, g in enumerate(groups)])
    sizes = prints.select(F.explode(keys).alias("k")).groupBy("k.part", "k.key").agg(F.count("*").alias("n"))
    pairs = sizes.groupBy("part").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs"))
    found = {r["part"]: r["pairs"] for r in _collected(pairs)}  # a row per part
    return [found.get(i, 0.0) for i in range(len(groups))]


# --- probe and verify -------------------------------------------------------------------------------------

def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _keys(prints: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, probe): every fingerprint under its own value of a part, and as a probe near it.

    Of two values that differ, the one with the lowest differing bit set probes the other, so a probe flips
    sets of bits whose lowest is set.
    """
    rows = []
    for part, (bits, threshold) in enumerate(plan):
        own = _masked("fp", bits)
        chosen = [(), *(c for n in range(1, threshold + 1) for c in combinations(bits, n))]
        # The lowest bit comes along: -mask would overflow for a mask of bit 63 alone.
        masks = [(_signed(sum(1 << b for b in c)), _signed(1 << min(c)) if c else 0) for c in chosen]
        masks = F.array(*[F.struct(F.lit(m).cast("bigint").alias("mask"), F.lit(b).cast("bigint").alias("lowest")) for m, b in masks])
        found = prints.select("fp", F.explode(masks).alias("m")).select("fp", "m.*")
        found = found.filter((F.col("mask") == 0) | (F.col("fp").bitwiseAND(F.col("lowest")) != 0))
        key = own.bitwiseXOR(F.col("mask")).alias("key")
        rows.append(found.select(F.lit(part).alias("part"), key, "fp", (F.col("mask") != 0).alias("probe")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionAll(more)
    return out


def _forest(fp: np.ndarray, probe: np.ndarray, bucket: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up all close pairs inside the buckets; no link that earlier ones imply.

    Rows of a bucket are next to each other. Row i is compared with i + 1, i + 2, ... as long as both are in
    one bucket and not known to be connected.
    """
    n = len(fp)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    active = np.arange(n)
    for step in range(1, n):
        active = active[active + step < n]
        active = active[bucket[active] == bucket[active + step]]
        if not active.size:
            break
        other = active + step
        close = np.bitwise_count(fp[active] ^ fp[other]) <= distance
        close &= ~(probe[active] & probe[other]) & (root[active] != root[other])
        for i, j in zip(active[close].tolist(), other[close].tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(j)
        if close.any():
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _compare(distance: int):
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def links(rows: pd.DataFrame) -> pd.DataFrame:
            at = rows[["part", "key", "low", "high"]].to_numpy()
            bucket = np.cumsum(np.any(at[1:] != at[:-1], axis=1), dtype=np.int64)
            fp = rows["fp"].to_numpy(dtype=np.int64)
            i, j = _forest(fp.view(np.uint64), rows["probe"].to_numpy(dtype=bool), np.append(0, bucket), distance)
            return pd.DataFrame({"u": fp[i], "v": fp[j]})

        for frame in frames:
            if not len(frame):
                continue
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = rows[["part", "key", "low", "high"]].iloc[-1]
            open_ = (rows[["part", "key", "low", "high"]] == last).all(axis=1).to_numpy()
            rest = rows[open_]  # may go on in the next batch; a block pair has a bounded number of rows
            if not open_.all():
                yield links(rows[~open_])
        if rest is not None and len(rest):
            yield links(rest)

    return batches


def near_links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(u, v) links between different fingerprints of ``prints`` (column fp, distinct) that suffice to connect
    every two that differ in at most ``distance`` bits; links that others imply are left out.

    Rows under one key are compared in the task that sorts them.  A key with more than ``block`` rows is cut
    into blocks, and every pair of blocks is a group of its own: no pair is lost and no task gets the key whole.
    """
    plan = search_plan(prints, distance)
    keys = _keys(prints, plan)
    sizes = keys.groupBy("part", "key").agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    cuts = sizes.select("part", "key", F.ceil(F.col("_n") / block).cast("int").alias("_cuts"))
    cut = F.coalesce("_cuts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), cut)
    placed = (
        keys.join(cuts, ["part", "key"], "left")
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), cut - 1)))
        .select(
            "part", "key", "fp", "probe",
            F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"),
        )
    )
    dealt = placed.repartition("part", "key", "low", "high").sortWithinPartitions("part", "key", "low", "high", "fp")
    return dealt.mapInPandas(_compare(distance), "u long, v long")


def near_duplicate_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    fingerprint is 16 lower-case hex digits; component_id is the least doc_id reachable over links of at most
    ``distance`` differing bits.  NULL, empty and wordless texts have fingerprint zero and link like any other.
    Repeated rows are returned as often as they come; a NULL doc_id is in its component but never names it
    unless there is no other (then component_id is NULL).  An empty table gives no rows.
    """
    marked = checkpointed(fingerprints(docs, key, text, shingle))
    prints = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(prints.select("fp"), distance))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.join(least, "root").select("fp", "component_id")
    return marked.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """The rows of ``docs``, all columns, whose key names its near-duplicate group; rows of a NULL key stay.

    Repeated rows share a key and stay together.  Rows that share a key only are told apart by their
    fingerprints.  The rows that go are broadcast only if counted to be few.  ``nearcopies.keep_one`` leaves one
    row of each group, whatever the keys.
    """
    groups = near_duplicate_groups(docs, key, text, shingle, distance)
    gone = groups.filter("doc_id is not null and component_id < doc_id")
    gone, _ = measured(gone.select(F.col("doc_id").alias("_gone"), F.col("fingerprint").alias("_print")).distinct(), ID_ROWS)
    own = fresh(docs, "_fp")
    marked = docs.withColumn(own, F.lower(F.lpad(F.hex(_printed(shingle)(F.col(text))), 16, "0")))
    return marked.join(gone, (marked[key] == gone["_gone"]) & (marked[own] == gone["_print"]), "left_anti").drop(own)
