"""Hilbert curves, nearest neighbours and exact k-means."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysmith.llm import centroids, neighbours
from tallysmith.llm.hilbert import hilbert_keys

KIND = "vec_id long, embedding array<double>, q string, v string, x string, cluster string, low string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, *["7", None] * 2, "8") for i, v in rows], KIND).repartition(3)


@pytest.mark.parametrize("dims, bits", [(2, 5), (3, 3), (5, 2)])
def test_hilbert_walks_through_every_cell(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_hilbert_refuses_long_keys():
    with pytest.raises(ValueError):
        hilbert_keys(np.zeros((1, 8), dtype=int), 8)


def plain_nearest(rows, k):
    """(query, rank, id, distance) by comparing everything; rows equal in id and vector once."""
    once = {(i, tuple(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for i, v in once:
        if i is not None and i % 10 == 0:
            others = [(math.dist(v, w), j is None, j or 0) for j, w in once if j != i and len(w) == len(v)]
            out |= {(i, n + 1, None if none else j, round(d, 9)) for n, (d, none, j) in enumerate(sorted(others)[:k])}
    return out


def odd_rows():
    rng = np.random.default_rng(1)
    same = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(1000 + i, list(same)) for i in range(60)]
    rows += [(2000 + i, [1.0, float(i % 3)]) for i in range(20)]
    rows += [(None, list(same)), (None, [3.0, 3.0, 3.0, 3.0]), (7000, None), (7010, []), (7020, [0.0] * 4), (7030, [1.0, None, 1.0, 1.0])]
    rows += [(7040, [float("nan"), 1.0, 1.0, 1.0]), (7050, [float("inf"), 1.0, 1.0, 1.0]), (30, rows[30][1]), (50, rows[51][1])]
    return rows + [(8000, [-0.0, 1.0, 1.0, 1.0]), (8001, [0.0, 1.0, 1.0, 1.0])]


def found(df, index, k=5):
    near = neighbours.nearest_rows(df, F.col("vec_id") % 10 == 0, k=k, index=index)
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in near.collect()}


def test_neighbours_of_odd_vectors(spark):
    """Equal vectors, other lengths, unusable vectors, NULL and repeated ids; small blocks dealt out in parts."""
    rows = odd_rows()
    whole = neighbours.Index(aim=1.0, block=16, queries=3)
    assert found(table(spark, rows), whole) == plain_nearest(rows, 5)


def test_windows_follow_the_data(spark):
    """Clustered vectors need narrow windows; an aim of one reaches every trial neighbour."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 20
    rows = [(i, (centres[i % 40] + rng.normal(size=16)).tolist()) for i in range(2000)]
    index = neighbours.Index(block=64)
    vectors = neighbours.distinct_vectors(
        table(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 10 == 0).alias("asked")), 5
    )
    share = neighbours.window_share(vectors, neighbours.positions(vectors, index), index, 5)
    assert 0 < share < 0.04
    hits = found(table(spark, rows), index) & plain_nearest(rows, 5)
    assert len(hits) >= 0.9 * 5 * 200


def test_positions_number_every_curve(spark):
    rows = [(i, [float(i % 7), float(i), 1.0]) for i in range(300)]
    vectors = neighbours.distinct_vectors(
        table(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(False).alias("asked")), 5
    )
    spots = neighbours.positions(vectors, neighbours.Index(curves=3)).collect()
    assert sorted((r.curve, r.spot) for r in spots) == [(c, s) for c in range(3) for s in range(300)]


def test_neighbours_of_nothing(spark):
    assert found(table(spark, []), neighbours.Index()) == set()
    assert found(table(spark, [(1, [1.0]), (3, [2.0])]), neighbours.Index()) == set()
    assert found(table(spark, [(10, [1.0])]), neighbours.Index()) == set()


def plain_clusters(rows, k, rounds, dims, scale, salt="3"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=mark)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), centres


@pytest.mark.parametrize("k, rounds, scale", [(5, 4, 1024), (3, 6, 2), (8, 2, 1 << 20), (300, 1, 16)])
def test_clusters_are_exact(spark, k, rounds, scale):
    """Against a plain version: ties, repeated rows, NULL ids, equal starts, empty clusters, values beyond doubles."""
    rows = odd_rows()
    got = centroids.cluster_vectors(table(spark, rows), k=k, rounds=rounds, dims=4, scale=scale)
    want, centres = plain_clusters(rows, k, rounds, 4, scale)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.rows.collect()), key=str) == want
    assert got.centroids.tolist() == centres
    told = centroids.described(got).collect()
    assert {r.inertia for r in told} == {sum(d for _, _, d in want)}
    for r in told:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_bounds_save_scans(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) + 9 * (i % 4)).tolist()) for i in range(800)]
    got = centroids.cluster_vectors(table(spark, rows), k=4, rounds=8, dims=6, scale=100)
    assert got.scans[-1] < 0.2 * len(rows)


def test_loosening_is_safe_and_less_than_the_drift():
    rng = np.random.default_rng(7)
    less = 0
    for _ in range(200):
        before, radius = rng.normal(size=(5, 3)) * 100, rng.random(5) * 60
        after = before + rng.normal(size=(5, 3)) * rng.choice([0, 1, 30])
        loss = centroids.loosening(before, after, radius)
        drift = np.linalg.norm(after - before, axis=1)
        for i in range(5):
            way = rng.normal(size=(400, 3))
            x = before[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i] * rng.random((400, 1)) ** (1 / 3)
            rest = [j for j in range(5) if j != i]
            shrunk = np.linalg.norm(x[:, None] - before[rest], axis=2) - np.linalg.norm(x[:, None] - after[rest], axis=2)
            assert shrunk.max() <= loss[i] + 1e-9 and loss[i] <= drift[rest].max() + 1e-9
            less += loss[i] < 0.8 * drift[rest].max()
    assert less > 200


def test_clusters_of_nothing_and_of_large_values(spark):
    empty = centroids.described(centroids.cluster_vectors(table(spark, [])))
    assert empty.collect() == [] and len(empty.columns) == 6
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(table(spark, [(1, [1e300] * 64)])).rows.collect()
