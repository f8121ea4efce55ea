"""Nearest neighbours along several shifted Hilbert curves through projections of the vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.functions.numbers import as_column
from tallysmith.llm.hilbert import hilbert_keys
from tallysmith.operators.common import checkpointed

#: Dimensions a curve runs through and bits of each; together at most 63.
DIMS, BITS = 6, 8
#: Found vectors kept beyond those asked for, until the exact distances are known.
SLACK = 5


@dataclass(frozen=True)
class Index:
    """Parameters of a search.  ``fit_rows`` and ``trial_rows`` bound the only rows that go to the driver."""

    curves: int = 8
    fit_rows: int = 4_096
    trial_rows: int = 256
    #: Share of the true neighbours of the trial queries that the windows have to reach.
    aim: float = 0.97
    block: int = 2_048
    queries: int = 1_024
    seed: int = 17


def usable(vector: Column | str) -> Column:
    """Whether a vector takes part: not NULL, every component a finite number, not all of them zero."""
    vector = as_column(vector)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays of doubles of one length."""
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row for each different vector: number, length, smallest ids, and whether a query has it.

    Of equal vectors only the k + 1 smallest ids can be among the k nearest rows of anything, so no more are kept;
    that cut happens in the tasks that read, and a vector on a third of all rows gathers nowhere.
    """
    ids = rows.groupBy("vector", "id").agg(F.max("asked").alias("asked"))
    order = Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last())
    least = ids.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    both = least.select("vector", "id", "place", F.lit(False).alias("asked")).union(
        ids.filter("asked").select("vector", F.lit(None).cast("long"), F.lit(None).cast("int"), "asked").distinct()
    )
    own = F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "id")))
    grouped = both.groupBy("vector").agg(F.sort_array(own).alias("own"), F.max("asked").alias("asked"))
    return checkpointed(
        grouped.select(
            F.monotonically_increasing_id().alias("v"), F.size("vector").alias("length"), "vector", "asked",
            F.col("own.id").alias("ids"), F.coalesce(F.col("own")[0]["id"], F.lit((1 << 63) - 1)).alias("low"),
        )
    )


def _table(column, length: int) -> np.ndarray:
    """Vectors of one length as a table of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _projection(index: Index, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of every curve; the same in every task."""
    draw = np.random.default_rng([index.seed, length])
    return draw.normal(size=(length, index.curves * DIMS)) / math.sqrt(length), draw.random(index.curves * DIMS)


def fit_cuts(vectors: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """For each length among a bounded sample: cut points that spread the projections evenly over half a grid."""
    sample = vectors.orderBy(F.xxhash64("v")).limit(index.fit_rows).select("length", "vector").toPandas()
    share = np.linspace(0, 1, (1 << (BITS - 1)) + 1)[1:-1]
    return {
        int(length): np.quantile(np.stack(rows["vector"].to_list()) @ _projection(index, int(length))[0], share, axis=0)
        for length, rows in sample.groupby("length")
    }


def curve_keys(points: np.ndarray, index: Index, cuts: np.ndarray | None) -> np.ndarray:
    """(points, curves) keys.  Without cut points the projections are taken as standard normal."""
    directions, shifts = _projection(index, points.shape[1])
    y = points @ directions
    half = 1 << (BITS - 1)
    if cuts is None:
        spot = np.clip((np.tanh(0.8 * y) + 1) / 2 * half, 0, half - 1).astype(np.int64)
    else:
        spot = np.stack([np.searchsorted(cuts[:, j], y[:, j]) for j in range(y.shape[1])], axis=1)
    cells = spot + np.floor(shifts * half).astype(np.int64)
    return np.stack([hilbert_keys(cells[:, j : j + DIMS], BITS) for j in range(0, cells.shape[1], DIMS)], axis=1)


def positions(vectors: DataFrame, index: Index) -> DataFrame:
    """(v, length, curve, spot, total): the place of every vector along every curve, from 0.

    Only keys are sorted, range-partitioned by Spark; the rows of earlier partitions are added to the place within
    a partition.
    """
    cuts = fit_cuts(vectors, index)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["length"].to_numpy()
            for length in np.unique(lengths):
                own = batch.filter(pa.array(lengths == length))
                found = curve_keys(_table(own["vector"], int(length)), index, cuts.get(int(length)))
                flat = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * index.curves, found.ravel())
                yield pa.record_batch([own["v"], own["length"], flat], names=["v", "length", "keys"])

    keyed = vectors.select("v", "length", "vector").mapInArrow(keys, "v long, length int, keys array<long>")
    long = keyed.select("v", "length", F.posexplode("keys").alias("curve", "key"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", "curve", "key", "v"]
    placed = long.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(
        placed.select(
            "v", "length", "curve", F.spark_partition_id().alias("part"),
            (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("at"),
        )
    )
    runs = placed.groupBy("length", "curve", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    line = Window.partitionBy("length", "curve")
    before = F.coalesce(F.sum("rows").over(line.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(
        "length", "curve", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(line).alias("total")
    )
    return placed.join(starts, ["length", "curve", "part"]).select(
        "v", "length", "curve", (F.col("at") + F.col("shift")).alias("spot"), "total"
    )


def _nearest(points: np.ndarray, low: np.ndarray, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its nearest points, ties by the smaller id, and their distances.

    Matrix products choose, with room for their rounding; distances come from the differences themselves.
    """
    squares = np.einsum("ij,ij->i", points, points)
    own = np.einsum("ij,ij->i", queries, queries)
    room = 1e-9 * (squares.max(initial=0) + own)
    rough = np.nan_to_num(squares[None, :] - 2 * (queries @ points.T) + own[:, None], nan=0.0)
    for i, line in enumerate(rough):
        if len(line) > most:
            chosen = np.flatnonzero(line <= np.partition(line, most - 1)[most - 1] + room[i])
        else:
            chosen = np.arange(len(line))
        exact = np.sqrt(((points[chosen] - queries[i]) ** 2).sum(axis=1))
        order = np.lexsort((low[chosen], exact))[:most]
        yield chosen[order], exact[order]


FOUND = "q long, v long, gap double"


def _pairs(q, points, ids, low, queries, most: int) -> pa.RecordBatch:
    left, right, gaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for name, (near, gap) in zip(q, _nearest(points, low, queries, most)):
        left.append(np.full(len(near), name, dtype=np.int64))
        right.append(ids[near])
        gaps.append(gap)
    return pa.table({"q": np.concatenate(left), "v": np.concatenate(right), "gap": np.concatenate(gaps)})


def _leading(pairs: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("gap", "low", "v")
    once = pairs.groupBy("q", "v").agg(F.min("gap").alias("gap")).join(vectors.select("v", "low"), "v")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def exact_pairs(vectors: DataFrame, queries, k: int) -> DataFrame:
    """The k + 1 nearest vectors, itself included, of a bounded set of query vectors, by comparing with every one."""
    groups = {int(n): (g["v"].to_numpy(), np.stack(g["vector"].to_list())) for n, g in queries.groupby("length")}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["length"].to_numpy()
            for length, (q, wanted) in groups.items():
                own = batch.filter(pa.array(lengths == length))
                if len(own):
                    points = _table(own["vector"], length)
                    found = _pairs(q, points, own["v"].to_numpy(), own["low"].to_numpy(), wanted, k + 1)
                    yield from found.to_batches()

    pairs = vectors.select("v", "length", "vector", "low").mapInArrow(search, FOUND)
    return _leading(pairs, vectors, k + 1)


def window_share(vectors: DataFrame, places: DataFrame, index: Index, k: int) -> float:
    """Half the width of the windows, as a share of the vectors, that reaches ``aim`` of the true neighbours.

    Measured on at most ``trial_rows`` query vectors, whose neighbours are found by comparing with every vector: a
    neighbour is reached if it is near enough along one curve at least.
    """
    trial = vectors.filter("asked").orderBy(F.xxhash64("v", F.lit(index.seed))).limit(index.trial_rows)
    queries = trial.select("v", "length", "vector").toPandas()
    if queries.empty:
        return 0.0
    pairs = exact_pairs(vectors, queries, k).filter("q <> v").select("q", "v")
    spots = places.select("v", "length", "curve", "spot", "total")
    there = pairs.join(spots, "v").withColumnRenamed("spot", "other").drop("length", "total")
    asked = spots.filter(F.col("v").isin([int(v) for v in queries["v"]])).withColumnRenamed("v", "q")
    gaps = there.join(asked, ["q", "curve"]).groupBy("q", "v").agg(
        F.min(F.abs(F.col("spot") - F.col("other")) / F.col("total")).alias("gap")
    )
    return float(gaps.agg(F.coalesce(F.percentile("gap", F.lit(index.aim)), F.lit(0.0))).first()[0])


def candidates(vectors: DataFrame, places: DataFrame, share: float, index: Index, k: int) -> DataFrame:
    """(q, v, place): for each query vector the nearest vectors found in its windows on all curves, itself among them.

    A curve is cut into blocks of equal numbers of vectors; a query goes to the blocks that its window touches.
    A block with many queries is dealt out again, so one task's group has ``block`` vectors and about ``queries``
    queries, however many rows or equal vectors there are.
    """
    wide = F.greatest(F.ceil(F.col("total") * F.lit(share)), F.lit(k + 1))
    by_vector = places.groupBy("v").agg(F.collect_list(F.struct("curve", "spot", "total")).alias("spots"))
    data = vectors.select("v", "length", "vector", "low", "asked").join(by_vector, "v").select(
        "v", "length", "vector", "low", "asked", F.explode("spots").alias("s")
    ).select("v", "length", "vector", "low", "asked", "s.*")
    block = lambda c: F.floor(c / F.lit(index.block))
    first = block(F.greatest(F.col("spot") - wide, F.lit(0)))
    last = block(F.least(F.col("spot") + wide, F.col("total") - 1))
    reach = places.join(vectors.filter("asked").select("v"), "v").select(
        "v", "length", "curve", F.explode(F.sequence(first, last)).alias("block")
    )
    key = ["length", "curve", "block"]
    load = reach.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(index.queries)).alias("shares"))
    share_of = F.pmod(F.xxhash64("v"), F.col("shares"))
    asking = (
        reach.join(load, key)
        .select(*key, share_of.alias("part"), F.col("v").alias("q"))
        .join(vectors.filter("asked").select(F.col("v").alias("q"), "vector"), "q")
    )
    stored = data.select("v", "length", "vector", "low", "curve", block(F.col("spot")).alias("block")).join(load, key)
    stored = stored.select(
        *key, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("part"), "v", "low", "vector"
    )

    def search(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(rows) or not len(wanted):
            return _pairs([], np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1)), 1)
        length = rows["length"][0].as_py()
        points, low = _table(rows["vector"], length), rows["low"].to_numpy()
        return _pairs(
            wanted["q"].to_numpy(), points, rows["v"].to_numpy(), low, _table(wanted["vector"], length), k + 1 + SLACK
        )

    group = [*key, "part"]
    pairs = stored.groupBy(*group).cogroup(asking.groupBy(*group)).applyInArrow(search, FOUND)
    return _leading(pairs, vectors, k + 1 + SLACK)


def nearest_rows(
    rows: DataFrame, asked: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10, index: Index = Index()
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest rows of every asked row, by Euclidean distance.

    Every vector is indexed and every asked row is a query.  How wide the windows are follows from a bounded trial
    (``window_share``), so recall is met on any data: on data with little structure the windows are wide and the
    search comes close to comparing each query with everything, on clustered data they are narrow.

    Vectors that are not ``usable`` take no part; vectors are only compared with those of their length.  A row is
    known by its id and vector: rows equal in both count once, and a query does not meet rows of its own id.  Rows
    with a NULL id are never queries, but are found, last among ties.  An empty table gives no rows; other columns
    are not looked at.
    """
    shaped = rows.select(
        F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(asked & F.col(id).isNotNull(), F.lit(False)).alias("asked"),
    ).filter(usable("vector"))
    # -0.0 and 0.0 are one value; adding zero makes them one bit pattern too.
    shaped = shaped.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    vectors = distinct_vectors(shaped, k)
    places = checkpointed(positions(vectors, index))
    share = window_share(vectors, places, index, k)
    found = checkpointed(candidates(vectors, places, share, index, k).select("q", "v"))
    met = found.join(vectors.select("v", F.col("vector").alias("there"), "ids"), "v").join(
        vectors.filter("asked").select(F.col("v").alias("q"), F.col("vector").alias("here")), "q"
    )
    scored = met.select("q", distance("here", "there").alias("score"), F.explode("ids").alias("vec_id"))
    names = shaped.filter("asked").select("id", "vector").distinct()
    queries = vectors.filter("asked").select("vector", F.col("v").alias("q")).join(names, "vector")
    order = Window.partitionBy("query_id", "q").orderBy("score", F.col("vec_id").asc_nulls_last())
    pairs = scored.join(queries.select("q", F.col("id").alias("query_id")), "q").filter(
        ~F.col("vec_id").eqNullSafe(F.col("query_id"))
    )
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
