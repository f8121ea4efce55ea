"""Exact integer k-means whose bounds are loosened by the geometry of moved centroids, not by their whole drift."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysmith.functions.numbers import as_column
from tallysmith.operators.common import scratch_root

#: Components beyond this could give squared distances that a long does not hold.
LARGEST = 1 << 26
#: Up to this size of components doubles are exact for every step of a squared distance.
EXACT = 1 << 21
STATE = "vec_id long, x array<int>, cluster int, upper double, lower double, distance long, moved array<long>, radius double"


def grid(vector: Column | str, scale: int) -> Column:
    """floor(scale * component) of each component; an error for values whose distances a long cannot hold."""
    scaled = F.transform(as_column(vector), lambda x: F.floor(F.lit(float(scale)) * x))
    wide = F.exists(as_column(vector), lambda x: F.abs(x) * F.lit(float(scale)) > LARGEST)
    return F.when(wide, F.raise_error(F.lit("components too large for exact squared distances"))).otherwise(
        F.transform(scaled, lambda x: x.cast("int"))
    )


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances (points, centres) of integer vectors."""
    if max(np.abs(points).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT:
        p, c = points.astype(np.float64), centres.astype(np.float64)
        parts = np.einsum("ij,ij->i", p, p)[:, None] - 2 * (p @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]
        return parts.astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)


def loosening(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster: by how much the distance to any other centroid can have shrunk for the points in its sphere.

    A centroid moves from f to g.  For a point x, |x-f| - |x-g| = (|x-f|^2 - |x-g|^2) / (|x-f| + |x-g|), at most
    |f-g| times the cosine of the angle at the middle of f and g between the way of the centroid and x, because
    |x-f| + |x-g| is at least twice the distance from that middle.  The sphere of a cluster, cut by the plane
    through its centre and the way, is a disk; its least angle is that of its centre less asin(radius / distance).
    """
    k = len(before)
    worst = np.zeros(k)
    for j in range(k):
        way = (after[j] - before[j]).astype(np.float64)
        drift = np.linalg.norm(way)
        if not drift:
            continue
        offset = before - (before[j] + after[j]) / 2
        far = np.linalg.norm(offset, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip(offset @ way / (far * drift), -1, 1)) - np.arcsin(np.clip(radius / far, 0, 1))
            part = np.where((far <= radius) | (angle <= 0), 1.0, np.maximum(np.cos(angle), 0.0))
        part[j] = 0
        worst = np.maximum(worst, drift * np.minimum(part + 1e-12, 1.0))
    return worst


@dataclass(frozen=True)
class Move:
    """What a pass needs to know: centroids, how far each went, and what bounds lose by it."""

    centres: np.ndarray
    shift: np.ndarray
    loss: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> Move:
        gaps = np.sqrt(squared(after, after).astype(np.float64))
        np.fill_diagonal(gaps, np.inf)
        shift = np.linalg.norm((after - before).astype(np.float64), axis=1)
        return cls(after, shift, loosening(before, after, radius), gaps.min(axis=1, initial=np.inf) / 2)


def reassign(
    points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New (cluster, upper, lower) and which points were scanned against every centroid.

    A point stays without a scan only if the bounds, with room for rounding, put every other centroid strictly
    farther away; so results, ties included, are those of a full scan.
    """
    cluster, upper, lower = cluster.copy(), upper + move.shift[cluster], np.maximum(lower - move.loss[cluster], 0.0)
    sure = lambda u, l, c: u * (1 + 1e-9) + 1e-6 < np.maximum(l, move.half[c]) * (1 - 1e-9)
    open_ = np.flatnonzero(~sure(upper, lower, cluster))
    if len(open_):
        own = points[open_] - move.centres[cluster[open_]]
        upper[open_] = np.sqrt((own * own).sum(axis=1).astype(np.float64))
        open_ = open_[~sure(upper[open_], lower[open_], cluster[open_])]
    if len(open_):
        gaps = squared(points[open_], move.centres)
        cluster[open_] = gaps.argmin(axis=1)
        near = np.sqrt(np.sort(gaps, axis=1)[:, :2].astype(np.float64))
        upper[open_] = near[:, 0]
        lower[open_] = near[:, 1] if gaps.shape[1] > 1 else np.inf
    return cluster, upper, lower, open_


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, pa.array(values.ravel(), kind))


def _pass(table: DataFrame, move: Move, first: bool, last: bool) -> DataFrame:
    """One assignment of every vector.  Besides the vectors each task gives one row a cluster: the change of its
    count and component sums, the largest upper bound, and the number of scans."""
    k, dims = move.centres.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros((k, dims + 2), dtype=np.int64)
        radius = np.zeros(k)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = batch["x"].flatten()
            points = x.to_numpy(zero_copy_only=False).reshape(n, dims).astype(np.int64)
            if first:
                old = np.zeros(n, dtype=np.int64)
                new, upper, lower, scanned = reassign(points, old, np.full(n, np.inf), np.zeros(n), move)
                changed = np.arange(n)
            else:
                old = batch["cluster"].to_numpy().astype(np.int64)
                state = batch["upper"].to_numpy(), batch["lower"].to_numpy()
                new, upper, lower, scanned = reassign(points, old, *state, move)
                changed = np.flatnonzero(new != old)
                np.subtract.at(moved, (old[changed], 0), 1)
                np.subtract.at(moved[:, 1:-1], old[changed], points[changed])
            np.add.at(moved, (new[changed], 0), 1)
            np.add.at(moved[:, 1:-1], new[changed], points[changed])
            np.add.at(moved, (new[scanned], dims + 1), 1)
            np.maximum.at(radius, new, upper)
            gaps = (points - move.centres[new]) if last else None
            distance = pa.array((gaps * gaps).sum(axis=1)) if last else pa.nulls(n, pa.int64())
            yield pa.record_batch(
                [batch["vec_id"], pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dims, x),
                 pa.array(new, pa.int32()), pa.array(upper), pa.array(lower), distance,
                 pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.float64())],
                names=NAMES,
            )
        yield pa.record_batch(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), pa.array(np.arange(k), pa.int32()),
             pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.int64()),
             _lists(moved, pa.int64()), pa.array(radius)],
            names=NAMES,
        )

    return table.mapInArrow(work, STATE)


NAMES = [c.split()[0] for c in STATE.split(", ")]


def _changes(table: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the changes (as Python integers) and the radius of every cluster; k * (dims + 2) numbers."""
    told = table.filter(F.col("moved").isNotNull())
    radius = np.zeros(k)
    for r in told.groupBy("cluster").agg(F.max("radius").alias("radius")).collect():
        radius[r.cluster] = r.radius
    sums = np.zeros((k, dims + 2), dtype=object)
    parts = told.select("cluster", F.posexplode("moved").alias("at", "value"))
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        sums[r.cluster, r.at] = int(r.value)
    return sums, radius


@dataclass(frozen=True)
class Clustering:
    """Vectors with cluster and squared distance, the centroids, and how many full scans each pass made."""

    rows: DataFrame
    centroids: np.ndarray
    scans: list[int]


def cluster_vectors(
    rows: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10,
    dims: int = 64, scale: int = 1024, salt: str = "3",
) -> Clustering:
    """k-means in integers: every step is exact, so reruns and any partitioning agree.

    Kept are vectors of ``dims`` components, none NULL or non-finite.  Centroids start as the vectors with the k
    smallest hashes of salt and id (ties by components, NULL ids last; fewer vectors, fewer centroids).  Each pass
    reads the table that the one before wrote and writes another; two folders take turns, so the disk holds two
    copies however many rounds there are, and a lost executor costs tasks of one pass.  Nothing is shuffled but
    k sums a task.  Repeated rows count as often as they occur; an empty table gives no rows; other columns are not
    looked at; components beyond 2**26 after scaling are an error, as their distances do not fit a long.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    kept = kept.filter((F.size("v") == dims) & F.coalesce(finite, F.lit(False))).select("vec_id", grid("v", scale).alias("x"))
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(mark.asc_nulls_last(), "x").limit(k).select("x").collect()
    centres = np.array([r.x for r in starts], dtype=np.int64).reshape(-1, dims)
    k = len(centres)
    session = rows.sparkSession
    if not k:
        return Clustering(session.createDataFrame([], "vec_id long, cluster int, distance long"), centres, [])
    root = f"{scratch_root(session).rstrip('/')}/{uuid.uuid4().hex}"
    table, scans, sums = kept, [], np.zeros((k, dims + 2), dtype=object)
    move = Move.of(centres, centres, np.zeros(k))
    for turn in range(rounds + 1):
        path = f"{root}-{turn % 2}"
        _pass(table, move, turn == 0, turn == rounds).write.mode("overwrite").parquet(path)
        written = session.read.schema(STATE).parquet(path)
        change, radius = _changes(written, k, dims)
        sums = sums + change
        scans.append(int(change[:, -1].sum()))
        table = written.filter("moved IS NULL")
        if turn < rounds:
            after = np.array(
                [[int(s) // int(row[0]) for s in row[1:-1]] if row[0] else old.tolist() for row, old in zip(sums, centres)],
                dtype=np.int64,
            )
            move, centres = Move.of(centres, after, radius), after
    return Clustering(table.select("vec_id", "cluster", "distance"), centres, scans)


def digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in centroids]


def described(found: Clustering) -> DataFrame:
    """The vectors with the inertia of their cluster and of all, and a digest of their centroid."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.total) for r in found.rows.groupBy("cluster").agg(total.alias("total")).collect()}
    names = digests(found.centroids)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values] or [F.lit(None)]), F.col("cluster") + 1)
    return found.rows.select(
        "vec_id", "cluster", "distance",
        pick([inertia.get(i, 0) for i in range(len(names))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), pick(names).cast("string").alias("centroid_sha256"),
    )
