"""Operators without a SQL oracle, checked against an independent numpy re-statement on a
small fixture drawn from the driver tables (sf0.001)."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from potentia.operators import cluster as C, graph as G, points as P, voltage as V
from potentia.sources.tables import load

SF = "/root/testdata/sf0.001"


def u(key, seed):
    h = hashlib.md5(f"{key}:{seed}".encode()).hexdigest()
    return int(h[:13], 16) / 4503599627370496.0


def _lineitem(spark, n=None):
    pts = P.from_lineitem(load(spark, SF, "lineitem")).select("id", "x")
    rows = pts.collect()
    ids = np.array([r["id"] for r in rows], dtype=np.int64)
    xs = np.array([r["x"] for r in rows], dtype=float)
    return pts, ids, xs


def _d2(a, b):
    acc = np.zeros((a.shape[0], b.shape[0]))
    for j in range(a.shape[1]):
        diff = a[:, j][:, None] - b[:, j][None, :]
        acc += diff * diff
    return acc


def streaming_kmeans_np(ids, xs, max_centroids, init_size, batch_size, seed, seed_rows=10):
    order = sorted(range(len(ids)), key=lambda i: (u(ids[i], f"stream:{seed}"), ids[i]))
    ids, xs = ids[order], xs[order]
    buf = xs[:init_size]
    d = _d2(buf, buf)
    off = ~np.eye(len(buf), dtype=bool)
    pos = d[off][d[off] > 0]
    mn, mx = pos.min(), d[off].max()
    z = mx - mn
    cents = [list(v) for v in buf[:seed_rows]]
    counts = [1] * len(cents)
    rest_ids, rest = ids[init_size:], xs[init_size:]
    batches = [(rest_ids[i:i + batch_size], rest[i:i + batch_size]) for i in range(0, len(rest), batch_size)]
    b = 0
    while len(cents) < max_centroids and b < len(batches):
        bid, bx = batches[b]
        dist = _d2(bx, np.array(cents)).min(axis=1)
        p = np.clip((dist - mn) / z, 0, 1)
        acc = [i for i in range(len(bid)) if u(bid[i], f"{seed}:{b}") < p[i] and dist[i] > 0]
        acc = acc[:max_centroids - len(cents)]
        for i in acc:
            cents.append(list(bx[i]))
            counts.append(1)
        if len(cents) == max_centroids and acc[-1] + 1 < len(bid):
            batches[b] = (bid[acc[-1] + 1:], bx[acc[-1] + 1:])  # the rest of the batch refines
        else:
            b += 1
    cents = np.array(cents)
    counts = np.array(counts, dtype=np.int64)
    tot_d2, tot_n, initial, mean = 0.0, 0, None, None
    while b < len(batches):
        bid, bx = batches[b]
        dd = _d2(bx, cents)
        a = dd.argmin(axis=1)
        for c in np.unique(a):
            m = a == c
            cents[c] = (cents[c] * counts[c] + bx[m].sum(axis=0)) / (counts[c] + m.sum())
            counts[c] += m.sum()
            tot_d2 += dd[m, c].sum()
            tot_n += m.sum()
        mean = tot_d2 / tot_n
        initial = mean if initial is None else initial
        b += 1
    return cents, counts, mn, mx, initial, mean


def test_streaming_kmeans_matches_numpy(spark):
    pts, ids, xs = _lineitem(spark)
    res = C.streaming_kmeans(pts, max_centroids=40, init_size=300, batch_size=700, seed=0)
    cents, counts, mn, mx, initial, mean = streaming_kmeans_np(ids, xs, 40, 300, 700, 0)
    st = res.stats.first()
    assert np.isclose(st["min_d2"], mn) and np.isclose(st["max_d2"], mx)
    got = res.centroids.orderBy("centroid_id").collect()
    assert len(got) == len(cents)
    assert [r["n"] for r in got] == list(counts)
    assert np.allclose(np.array([r["x"] for r in got]), cents, atol=1e-9)
    assert np.isclose(st["initial_mean_d2"], initial) and np.isclose(st["mean_d2"], mean)


def test_kmeans_pp_matches_numpy(spark):
    pts, ids, xs = _lineitem(spark)
    got = [r["id"] for r in C.kmeans_pp(pts, 6, 3).orderBy("centroid_id").collect()]
    # independent re-statement: weighted draw by exponential keys, weight = distance to nearest centre
    keys = [(-np.log(1.0 - u(i, "3:0")), i) for i in ids]
    first = min(range(len(ids)), key=lambda j: keys[j])
    chosen = [first]
    mind = np.sqrt(_d2(xs, xs[[first]])[:, 0])
    for k in range(1, 6):
        cand = [(-np.log(1.0 - u(ids[j], f"3:{k}")) / mind[j], ids[j], j) for j in range(len(ids)) if mind[j] > 0]
        j = min(cand)[2]
        chosen.append(j)
        mind = np.minimum(mind, np.sqrt(_d2(xs, xs[[j]])[:, 0]))
    assert got == [int(ids[j]) for j in chosen]


def test_two_region_solve_matches_dense(spark):
    s = load(spark, SF, "supplier").orderBy("s_suppkey").collect()
    x = np.array([(r["s_acctbal"] + 1000.0) / 11000.0 * 3.0 for r in s])
    ids = np.array([r["s_suppkey"] for r in s])
    pts = spark.createDataFrame([(int(i), [float(v)], 1.0) for i, v in zip(ids, x)], "id long, x array<double>, weight double")
    g = G.knn_graph(pts, 3, None, universal_ground=False)
    fixed = {int(i): (1.0 if v > 2 else 0.0) for i, v in zip(ids, x) if v < 1 or v > 2}
    lms = spark.createDataFrame([(0, i, v) for i, v in fixed.items()], "problem_id int, id long, voltage double")
    got = {r["id"]: r["v"] for r in V.conjugate_gradient(g, lms, tol=1e-12).collect()}
    # dense re-statement: Laplacian system on the free nodes
    e = g.edges.collect()
    idx = {int(i): k for k, i in enumerate(ids)}
    W = np.zeros((len(ids), len(ids)))
    for r in e:
        W[idx[r["src"]], idx[r["dst"]]] = r["w"]
    Lp = np.diag(W.sum(axis=1)) - W
    free = [k for k, i in enumerate(ids) if int(i) not in fixed]
    fix = [k for k, i in enumerate(ids) if int(i) in fixed]
    vf = np.array([fixed[int(ids[k])] for k in fix])
    sol = np.linalg.solve(Lp[np.ix_(free, free)], -Lp[np.ix_(free, fix)] @ vf)
    for k, v in zip(free, sol):
        assert abs(got[int(ids[k])] - v) < 1e-7
    assert all(-1e-9 <= v <= 1 + 1e-9 for v in got.values())  # maximum principle


def test_cells_knn_exact_with_hot_duplicate_cell(spark):
    """A third of the points are one repeated coordinate (a hot cell): chunking + salting
    must still give exactly the brute-force neighbours, ties broken by id."""
    from potentia.operators import neighbors as N
    rng = np.random.default_rng(7)
    n = 900
    xs = rng.random((n, 3))
    xs[: n // 3] = 0.5  # hot duplicate group
    pts = spark.createDataFrame([(i, [float(v) for v in xs[i]]) for i in range(n)], "id long, x array<double>")
    got = N.knn_cells(pts, pts, 5, exclude_self=True, cells=12, probes=2, chunk_rows=64)
    got = sorted((r["src"], r["rank"], r["dst"]) for r in got.collect())
    d = _d2(xs, xs)
    np.fill_diagonal(d, np.inf)
    exp = []
    for i in range(n):
        order = sorted(range(n), key=lambda j: (d[i, j], j))[:5]
        exp += [(i, r + 1, j) for r, j in enumerate(order)]
    assert got == sorted(exp)
