"""Cases that once failed: large ids in the two-level solve, unreached points, line order over several
files, repeated lines in a shuffle, landmarks named twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from potentia.operators import cluster as C
from potentia.operators import evaluate as E
from potentia.operators import graph as G
from potentia.operators import landmarks as L
from potentia.operators import neighbors as N
from potentia.operators import voltage as V
from potentia.sources import sinks, vectors


def line_graph(spark, n, offset=0):
    e = [(i + offset, j + offset, 1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    return G.with_ground(spark.createDataFrame(e, "src long, dst long, w double"),
                         spark.createDataFrame([(i + offset,) for i in range(n)], "id long"), 1.0)


def local_by_hand(n, g, cells, centre_v, adjacent, hold):
    """Dense solve: inner edges, ties to adjacent centres, held nodes."""
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(n):
        a[i, i] = g
        for j in (i - 1, i + 1):
            if not 0 <= j < n:
                continue
            if cells[i] == cells[j]:
                a[i, i] += 1
                a[i, j] -= 1
            elif (cells[i], cells[j]) in adjacent or (cells[j], cells[i]) in adjacent:
                a[i, i] += 1
                b[i] += centre_v[cells[j]]
    for i, v in hold.items():
        a[i], b[i] = 0, v
        a[i, i] = 1
    return np.linalg.solve(a, b)


@pytest.mark.parametrize("offset", [0, 1 << 41, 1 << 60])
def test_local_solve_ties_to_the_neighbours_centres(spark, offset):
    n = 30
    graph = line_graph(spark, n, offset)
    cells = [i // 8 for i in range(n)]
    centre_v = {c: 0.9 - 0.2 * c for c in set(cells)}
    adjacent = {(0, 1), (1, 2)}  # 2 and 3 are not neighbours: their edge is left out
    got = V.local_solve(graph, spark.createDataFrame([(0, offset, 1.0)], "problem_id int, id long, voltage double"),
                        spark.createDataFrame([(i + offset, c) for i, c in enumerate(cells)], "id long, centroid_id long"),
                        spark.createDataFrame([(0, c, v) for c, v in centre_v.items()], "problem_id int, centroid_id long, v double"),
                        spark.createDataFrame(list(adjacent), "c1 long, c2 long"), tol=1e-13)
    v = {r.id - offset: r.v for r in got.collect()}
    want = local_by_hand(n, graph.total_w / n / n, cells, centre_v, adjacent, {0: 1.0})
    assert np.allclose([v[i] for i in range(n)], want, atol=1e-9) and len(v) == n


def test_unreached_points_have_no_prediction(spark):
    graph = line_graph(spark, 60)
    lms = spark.createDataFrame([(0, 0, 1.0, 0), (1, 59, 1.0, 1)], "problem_id int, id long, voltage double, label int")
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(60)], "id long, label int")
    few = V.jacobi(graph, lms, max_iters=10)
    assert {r.id for r in V.unreached(few).collect()} == set(range(11, 49))
    pred = E.classify(few, lms, labels)
    assert pred.where("NOT reached AND predicted IS NULL").count() == 38
    assert pred.where("reached AND predicted = label").count() == 22
    assert E.accuracy(pred).first().wrong == 38
    full = E.classify(V.conjugate_gradient(graph, lms), lms, labels)
    assert full.where("reached AND predicted = label").count() == 60


def test_iteration_limit_is_an_error(spark):
    graph = line_graph(spark, 40)
    lms = spark.createDataFrame([(0, 0, 1.0)], "problem_id int, id long, voltage double")
    with pytest.raises(V.NotConverged):
        V.conjugate_gradient(graph, lms, max_iters=2)
    assert V.conjugate_gradient(graph, lms, max_iters=2, partial=True).count() == 40


def test_sweep_moves_contributions_only(spark):
    graph = line_graph(spark, 50)
    s = V._Sweeper(graph, [0, 1])
    s.start(graph.nodes.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("problem_id")).select(
        "problem_id", "id", V._place([0, 1]), F.lit(1.0).alias("v")))
    s.advance(s.gather(s.state, "v", [0, 1]).select("problem_id", "id", "_q", F.col("_wv").alias("v")), {"n": F.col("v")})
    plan = s.gather(s.state, "v", [0, 1])._jdf.queryExecution().executedPlan().toString()
    top = [x for x in plan.split("InMemoryRelation")[0].split("\n") if "Exchange" in x]
    assert len(top) <= 1


def test_line_numbers_follow_paths(spark, tmp_path):
    for name, n in (("a", 1), ("b", 200), ("c", 2)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i} 1.0 2.0\n" for i in range(n)))
    rows = vectors.read_vectors(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(203))
    assert [r.label for r in rows] == ["a0", *[f"b{i}" for i in range(200)], "c0", "c1"]
    assert [r.label for r in vectors.head(vectors.read_vectors(spark, str(tmp_path)), 3).collect()] == ["a0", "b0", "b1"]


def test_shuffle_parts_equal_lines(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"line{i % 5}") for i in range(500)], "row_id long, value string")
    sinks.write_shuffled_text(lines, str(tmp_path / "out"), 3)
    got = [r.value for r in vectors.number_lines(spark.read.text(str(tmp_path / "out"))).orderBy("row_id").collect()]
    assert sorted(got) == sorted(f"line{i % 5}" for i in range(500))
    assert sum(a != b for a, b in zip(got, got[1:])) > 300


def test_declared_length_and_records(spark, tmp_path):
    p = tmp_path / "points.json"
    p.write_text('{"length": 3, "data": [[1, 2], [3.5, -4],\n [5e0, 6]]}')
    assert [list(r.x) for r in vectors.read_point_file(spark, str(p)).orderBy("id").collect()] == [[1, 2], [3.5, -4], [5, 6]]
    p.write_text('{"data": [[1, 2]], "length": 2}')
    with pytest.raises(ValueError, match="declares 2"):
        vectors.read_point_file(spark, str(p))


def test_later_landmark_wins(spark):
    kind = "problem_id int, id long, voltage double"
    got = L.add(spark.createDataFrame([(0, 1, 0.2), (0, 2, 0.3)], kind), spark.createDataFrame([(0, 1, 0.7), (1, 1, 0.4)], kind))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 0.7), (0, 2, 0.3), (1, 1, 0.4)]


def brute_pairs(x):
    return {(i, j): float(((x[i] - x[j]) ** 2).sum()) for i in range(len(x)) for j in range(i + 1, len(x))}


def test_pairs_by_blocks_equal_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(N, "_PAIR_BLOCK", 16)
    x = np.random.default_rng(0).integers(0, 9, (90, 3)).astype(float)
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    want = brute_pairs(x)
    for most in (10, 1000):
        got = {(r.id1, r.id2): r.d2 for r in N.all_pairs(pts, max_points=most).collect()}
        assert got == want
        mm = N.pairwise_min_max(pts, max_points=most).first()
        assert mm.max_d2 == max(want.values()) and mm.min_d2 == min(v for v in want.values() if v > 0)
    near = {(r.id1, r.id2) for r in N.all_pairs(pts, max_points=10, max_d2=4.0).collect()}
    assert near == {p for p, d in want.items() if d <= 4.0}


def test_knn_plans_agree_on_ties(spark):
    """A grid is full of ties at the k-th distance: cells and broadcast give the same neighbours."""
    pts = spark.createDataFrame([(i, [float(i % 20), float(i // 20)]) for i in range(400)], "id long, x array<double>")
    a = {tuple(r) for r in N.knn(pts, pts, 5, exclude_self=True).select("src", "dst", "rank").collect()}
    b = {tuple(r) for r in N.knn_cells(pts, pts, 5, exclude_self=True, cells=12).select("src", "dst", "rank").collect()}
    assert a == b


def test_kernels_and_distances_by_choice(spark):
    pts = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id long, x array<double>")
    with pytest.raises(ValueError, match="unknown kernel"):
        G.kernel_edges(pts, "gausian", 1.0)
    e = {(r.src, r.dst): r.w for r in G.kernel_edges(pts, lambda d2, c: F.lit(c) / (d2 + 1), 2.0).collect()}
    assert e[(0, 3)] == 0.2 and len(e) == 20
    with pytest.raises(ValueError):
        V.solve(line_graph(spark, 4), spark.createDataFrame([(0, 0, 1.0)], "problem_id int, id long, voltage double"), "magic")
    square = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 3.0]), (2, [0.0, 5.0])], "id long, x array<double>")
    assert {r.id for r in C.kmeans_pp(square, 3, 1, distance="manhattan").collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        C.kmeans_pp(square, 2, 1, distance="no such")


def test_mean_shift_bisects_to_the_count(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([c + rng.normal(size=(12, 2)) * 0.05 for c in ((0, 0), (3, 0), (0, 3))])
    pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, x array<double>")
    bandwidth, modes = C.mean_shift_for_count(pts, 3)
    assert modes.count() == 3 and sorted(r.n for r in modes.collect()) == [12, 12, 12]
    with pytest.raises(ValueError, match="no bandwidth"):
        C.mean_shift_for_count(pts, 1000, max_tries=2)
