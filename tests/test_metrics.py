"""Assignment, centres and Lloyd rounds by distance against numpy."""

import numpy as np
import pytest

from potentia.operators import metrics as M


def frames(spark, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(25, 3)) * 0.3 + c for c in ((3, 0, 0), (0, 4, 0), (0, 0, 5))])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, x array<double>")
    seeds = spark.createDataFrame([(k, [float(c) for c in x[i]]) for k, i in enumerate((0, 30, 60))], "centroid_id long, x array<double>")
    return x, df, seeds


def plain(x, c, kind):
    diff = x[:, None] - c[None]
    if kind == "euclidean":
        return np.sqrt(np.square(diff).sum(2))
    if kind == "manhattan":
        return np.abs(diff).sum(2)
    if kind == "chebyshev":
        return np.abs(diff).max(2)
    return 1 - x @ c.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None])


def centre(some, kind):
    if kind == "manhattan":
        return np.median(some, axis=0)
    if kind == "chebyshev":
        return (some.min(0) + some.max(0)) / 2
    if kind == "cosine":
        m = (some / np.linalg.norm(some, axis=1)[:, None]).mean(0)
        return m / np.linalg.norm(m)
    return some.mean(0)


@pytest.mark.parametrize("kind", M.DISTANCES)
def test_rounds_by_distance(spark, kind):
    x, df, seeds = frames(spark)
    c = x[[0, 30, 60]].copy()
    got = {r.id: (r.centroid_id, r.dist) for r in M.nearest_by(df.repartition(3), seeds, kind).collect()}
    d = plain(x, c, kind)
    assert all(got[i][0] == d[i].argmin() and got[i][1] == pytest.approx(d[i].min(), abs=1e-12) for i in range(len(x)))
    for _ in range(2):
        own = plain(x, c, kind).argmin(1)
        c = np.array([centre(x[own == k], kind) for k in range(3)])
    out = {r.centroid_id: (r.n, r.x) for r in M.lloyd_by(df, seeds, kind, 3, max_iter=2).collect()}
    assert sum(n for n, _ in out.values()) == len(x) and all(np.allclose(out[k][1], c[k]) for k in range(3))


def test_ties_zero_vectors_and_names(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "id long, x array<double>")
    cents = spark.createDataFrame([(7, [1.0, 0.0]), (4, [0.0, 1.0])], "centroid_id long, x array<double>")
    assert {r.id: r.centroid_id for r in M.nearest_by(df, cents, "manhattan").collect()} == {1: 4, 2: 4}
    assert [r.id for r in M.nearest_by(df, cents, "cosine").collect()] == [2]
    with pytest.raises(ValueError, match="unknown distance"):
        M.nearest_by(df, cents, "hamming")
    with pytest.raises(ValueError, match="max_broadcast_bytes"):
        M.nearest_by(df, cents, "manhattan", max_broadcast_bytes=8)
    assert M.nearest_by(df.limit(0), cents).count() == 0
