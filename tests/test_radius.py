"""Radius index, mean shift and kernel cut-off against brute force, on both paths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from potentia.operators import cluster as C
from potentia.operators import graph as G
from potentia.operators import neighbors as N
from potentia.operators import radius as R

INDEX = {"max_scan_rows": 0, "pivots": 12, "chunk_rows": 20}  # force balls, chunks and salts
PATHS = [{}, INDEX]


def cloud(spark, n=300, d=10, seed=0, hot=80):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:hot] = x[0] + rng.normal(size=(hot, d)) * 0.02  # a third of the points in one ball
    x[hot:hot + 10] = x[hot]  # equal points
    ids = rng.permutation(n) * 3
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x)]
    return rows, spark.createDataFrame(rows, "id long, x array<double>")


def brute_pairs(rows, r):
    out = {}
    for i, x in rows:
        for j, y in rows:
            if i < j:
                d2 = 0.0
                for a, b in zip(x, y):
                    d2 += (a - b) * (a - b)
                if d2 <= r * r:
                    out[i, j] = d2
    return out


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("d, r", [(2, 0.3), (10, 2.5), (40, 7.0)])
def test_radius_join(spark, path, d, r):
    rows, df = cloud(spark, d=d)
    got = [(t.id1, t.id2, t.d2) for t in R.radius_join(df.repartition(5), r, **path).collect()]
    want = brute_pairs(rows, r)
    assert len(got) == len(want) and {(a, b): c for a, b, c in got} == want and len(want) > 3000


def test_boundary_distance_is_inside(spark):
    df = spark.createDataFrame([(1, [0.0] * 9), (2, [1.0] * 9), (3, [1.0] * 8 + [1.0 + 1e-9])], "id long, x array<double>")
    for path in PATHS:
        assert {(t.id1, t.id2) for t in R.radius_join(df, 3.0, **path).collect()} == {(1, 2), (2, 3)}


def test_radius_join_of_nothing(spark):
    df = spark.createDataFrame([], "id long, x array<double>")
    assert R.radius_join(df, 1.0).count() == 0
    assert R.radius_join(df, 1.0, **INDEX).count() == 0


@pytest.mark.parametrize("path", PATHS)
def test_sums_and_best_with_a_radius_each(spark, path):
    rows, df = cloud(spark, d=5)
    points = df.withColumn("rank", F.col("id") % 7)
    queries = df.where("id % 2 = 0").withColumn("r", (F.col("id") % 5 + 1) * 0.5)
    sums = {t.id: (t.n, t.sx) for t in R.radius_sums(R.RadiusIndex(df, **path), queries).collect()}
    best = {t.id: (t.rank, t.first) for t in R.best_in_reach(R.RadiusIndex(points, carry=("rank",), **path), queries).collect()}
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    for i, v in rows:
        if i % 2:
            continue
        near = np.flatnonzero(np.square(x - v).sum(1) <= ((i % 5 + 1) * 0.5) ** 2)
        assert sums[i][0] == len(near) and np.allclose(sums[i][1], x[near].sum(0))
        top = max(k % 7 for k in ids[near].tolist())
        assert best[i] == (top, min(k for k in ids[near].tolist() if k % 7 == top))


def brute_shift(rows, r, iters=50):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    m = x.copy()
    for _ in range(iters):
        near = np.square(m[:, None] - x[None]).sum(2) <= r * r
        m = near @ x / near.sum(1)[:, None]
    n = (np.square(m[:, None] - x[None]).sum(2) <= r * r).sum(1)
    kept = []
    for k in sorted(range(len(ids)), key=lambda k: (-n[k], ids[k])):
        if all(np.square(m[k] - m[j]).sum() > r * r for j in kept):
            kept.append(k)
    return [(int(n[k]), m[k]) for k in kept]


@pytest.mark.parametrize("path", [{}, {"max_scan_rows": 0, "pivots": 3, "chunk_rows": 64}])
def test_mean_shift_several_bandwidths(spark, path):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(12, 8)) * 0.2 + c for c in (0, 3, 7)])
    rows = [(i * 2, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    widths = [0.5, 1.5, 9.0]
    got = C.mean_shift(df, widths, **path).collect()
    for p, r in enumerate(widths):
        mine = sorted((t.mode_id, t.n, t.x) for t in got if t.problem_id == p)
        want = brute_shift(rows, r)
        assert [m[1] for m in mine] == [n for n, _ in want] and [m[0] for m in mine] == list(range(len(want)))
        assert np.allclose([m[2] for m in mine], [v for _, v in want], atol=1e-6)


def test_bandwidth_search_takes_the_same_tries(spark):
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 0.1, 5, 5.1, 20, 20.1])], "id long, x array<double>")
    tries, lo, hi = [], 0.01, 10.0
    rows = [(r.id, r.x) for r in df.collect()]
    while True:
        tries.append(math.sqrt(lo * hi))
        k = len(brute_shift(rows, tries[-1]))
        if k == 2:
            break
        lo, hi = (tries[-1], hi) if k > 2 else (lo, tries[-1])
    bandwidth, modes = C.mean_shift_for_count(df, 2, ahead=2)
    assert bandwidth == pytest.approx(tries[-1]) and modes.count() == 2 and len(tries) > 2
    bandwidth, modes = C.mean_shift_for_count(df, 5, max_tries=3, exact=False)
    assert modes.count() in (3, 6)


def test_mean_shift_of_nothing(spark):
    df = spark.createDataFrame([], "id long, x array<double>")
    assert C.mean_shift(df, 1.0).count() == 0


@pytest.mark.parametrize("min_w", [0.3, 1e-4])
def test_kernel_cut_off_keeps_the_same_rows(spark, min_w):
    rows, df = cloud(spark, n=120, d=12, hot=30)
    dense = N.all_pairs(df).select("id1", "id2", F.exp(-F.col("d2") / (2 * 1.3 * 1.3)).alias("w")).where(F.col("w") > min_w)
    want = {(t.id1, t.id2): t.w for t in dense.collect()}
    got = {(t.src, t.dst): t.w for t in G.kernel_edges(df, "gaussian", 1.3, min_w=min_w).collect()}
    assert {k: w for k, w in got.items() if k[0] < k[1]} == pytest.approx(want) and len(got) == 2 * len(want)


def test_radial_kernel_in_many_dimensions(spark):
    rows, df = cloud(spark, n=100, d=15, hot=30)
    got = {(t.src, t.dst) for t in G.kernel_edges(df, "radial", 4.0).collect()}
    want = brute_pairs(rows, 4.0)
    assert got == {p for a, b in want for p in ((a, b), (b, a))}
