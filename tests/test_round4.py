"""Round 4: pairs that leave their kernels as they are made, and what a solve leaves on disk."""

import numpy as np
from pyspark.sql import functions as F

from potentia.functions import vec
from potentia.operators import neighbors as N


def _points(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(u) for u in row]) for i, row in zip(ids, x)], "id long, x array<double>")


def _brute(ids, x, r):
    n = len(ids)
    return sorted((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i in range(n) for j in range(i)
                  if ids[i] != ids[j] and N._sq_dists(x[i:i + 1], x[j:j + 1])[0, 0] <= r * r)


def test_grid_radius_join_meets_in_tiles(spark):
    rng = np.random.default_rng(3)
    x, ids = np.round(rng.random((250, 2)) - 0.5, 2), np.arange(250) * 2
    x[:80] = [0.11, -0.2]  # one cell with a third of the points
    ids[10] = ids[11]
    odd = spark.createDataFrame([(None, [0.0, 0.0]), (5, None), (7, [None, None]), (9, [float("nan"), 0.0])], "id long, x array<double>")
    points = _points(spark, ids, x).unionByName(odd)
    want = _brute(ids, x, 0.07)
    for kw in ({}, {"tile_rows": 1}, {"tile_rows": 1, "chunk_rows": 30}):
        assert sorted((p.id1, p.id2) for p in N.radius_join_grid(points, 0.07, **kw).collect()) == want


def test_rounded_is_round(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.random(4000) * 10.0 ** rng.uniform(-14, 3, 4000), np.round(rng.random(2000), 12) + 0.5e-12,
                        [0.0, -1.5, np.nan, np.inf, 1e300, 0.5e-12, 1.5e-12, 2.5e-12]])
    df = spark.createDataFrame([(float(a),) for a in v] + [(None,)], "a double")
    for places in (6, 12):
        assert df.where(~vec.rounded("a", places).eqNullSafe(F.round("a", places))).count() == 0


def test_a_solve_leaves_nothing_on_disk_but_its_result(spark, monkeypatch, tmp_path):
    import os

    from potentia.operators import blocks as B, voltage as V
    from potentia.operators.graph import Graph
    env, dropped, drop = spark._jvm.org.apache.spark.SparkEnv.get(), [], B.drop_shuffle

    def noted(shuffled):
        dropped.append(shuffled._jrdd.rdd().dependencies().apply(0).rdd().dependencies().apply(0).shuffleId())
        drop(shuffled)

    monkeypatch.setattr(B, "drop_shuffle", noted)
    monkeypatch.setattr(B, "PART_SIZE", 20)
    monkeypatch.setattr(B, "CHECKPOINT_EVERY", 3)
    n = 30
    edges = spark.createDataFrame([(a, b, 1.0) for i in range(n) for a, b in ((i, (i + 1) % n), ((i + 1) % n, i))], "src long, dst long, w double")
    nodes = spark.createDataFrame([(i, 2.0, 0.1) for i in range(n)], "id long, deg double, g double")
    landmarks = spark.createDataFrame([(0, 3, 1.0), (1, 9, 1.0)], "problem_id int, id long, voltage double")
    place = V.checkpoint_dir(spark).removeprefix("file:")
    before, rounds = set(os.listdir(place)), []
    out = V.conjugate_gradient(Graph(edges, nodes, n, 2.0 * n), landmarks, tol=1e-10, trace=rounds)
    assert out.count() == 2 * n
    assert rounds[0] > 6 and len(dropped) >= rounds[0] and not any(env.mapOutputTracker().getNumAvailableOutputs(i) for i in dropped)
    assert len(set(os.listdir(place)) - before) == 1  # the result


def test_pairs_leave_a_group_in_pieces(spark, monkeypatch):
    from potentia.operators import radius as R
    x, ids = np.zeros((900, 1)), np.arange(900)
    parts = list(R._fold(R.Pairs(), ids, x, np.ones(900), ids, x, {}, np.ones(900, bool)))
    assert sum(p.num_rows for p in parts) == 900 * 899 // 2
    assert len(parts) > 1 and max(p.num_rows for p in parts) <= R._OUT_ROWS + R._CELLS


def test_given_row_sums_go_to_the_edges(spark):
    from potentia.operators import graph as G
    x = np.random.default_rng(2).random((60, 1)) * 6
    points = _points(spark, range(60), x).withColumn("weight", F.lit(1.0))
    edges = G.kernel_edges(points, "gaussian", 0.5, min_w=0.01)
    given = G.row_stochastic(edges, G.kernel_degrees(points, 0.5, min_w=0.01))
    assert "SortMergeJoin" not in given._jdf.queryExecution().executedPlan().toString()
    want = {(r.src, r.dst): r.w for r in G.row_stochastic(edges).collect()}
    got = {(r.src, r.dst): r.w for r in given.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_all_pairs_of_many_rows_exchange_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "_PAIR_BLOCK", 16)
    rng = np.random.default_rng(7)
    for n in (100, 128, 17):  # odd and even numbers of blocks
        ids, x = np.arange(n) * 3, rng.random((n, 1))
        ids[n // 2] = ids[n // 2 - 1]
        pairs = N.all_pairs(_points(spark, ids, x), max_points=10)
        assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert sorted((p.id1, p.id2) for p in pairs.collect()) == _brute(ids, x, 9.0)
        monkeypatch.setattr(N, "_PAIR_SENT", 10)  # dealt to groups
        assert sorted((p.id1, p.id2) for p in N.all_pairs(_points(spark, ids, x), max_points=10).collect()) == _brute(ids, x, 9.0)
        monkeypatch.undo()
        monkeypatch.setattr(N, "_PAIR_BLOCK", 16)
