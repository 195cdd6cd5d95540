"""What is sent, and how many jobs, grow no faster than the rows: radius search in blocks, degrees without edges, kNN chunks,
batches of a stream in lots."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from potentia.operators import cluster as C
from potentia.operators import graph as G
from potentia.operators import neighbors as N
from potentia.operators import radius as R
from potentia.operators.staged import StagedPoints
from potentia.streaming import stream as ST


@pytest.fixture(scope="module")
def wide(spark):
    """Points that no ball can leave out."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[5] = x[4]
    return x, spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").persist()


INDEX = {"max_scan_rows": 0, "pivots": 60, "chunk_rows": 40}


def brute(x, r):
    d2 = np.square(x[:, None] - x[None]).sum(2)
    return {(7 * i, 7 * j) for i in range(len(x)) for j in range(i + 1, len(x)) if d2[i, j] <= r * r}


def test_points_that_balls_do_not_part_meet_in_blocks(spark, wide, monkeypatch):
    """A query was sent to every ball; it is sent to the blocks of points, fewer by far."""
    x, points = wide
    sent = []
    meet = R.RadiusIndex._meet

    def counted(self, asked, held, *rest):
        sent.append((asked.count() + held.count()) / len(x))
        return meet(self, asked, held, *rest)

    monkeypatch.setattr(R.RadiusIndex, "_meet", counted, raising=False)
    found = {(a, b) for a, b, _ in R.radius_join(points, 1.3, **INDEX).collect()}
    assert found == brute(x, 1.3)
    assert sent and sent[0] <= 2 * 10  # 400 rows in 10 blocks
    # where balls part the points, they are still used
    line = spark.createDataFrame([(i, [float(i)]) for i in range(400)], "id long, x array<double>")
    monkeypatch.setattr(R.RadiusIndex, "_meet_blocks", None, raising=False)
    assert R.radius_join(line, 1.5, **INDEX).count() == 399


def test_blocks_answer_other_queries_and_folds(spark, wide):
    x, points = wide
    asked = points.where("id % 3 = 0").withColumn("r", F.lit(1.35))
    index = R.RadiusIndex(points, **INDEX)
    assert index._groups_a_query(asked) > index._blocks()
    got = {r["id"]: (r["n"], r["sx"]) for r in R.radius_sums(index, asked).collect()}
    for i in range(0, 400):
        if 7 * i % 3 == 0:
            near = np.square(x[i] - x).sum(1) <= 1.35 ** 2
            assert got[7 * i][0] == near.sum() and np.allclose(got[7 * i][1], x[near].sum(0))


@pytest.mark.parametrize("index", [{}, INDEX])
def test_degrees_without_edges(spark, wide, index):
    """the degrees are those of the edges, and the edges are not stored."""
    x, points = wide
    c, min_w = 0.5, 0.03
    w = np.exp(-np.square(x[:, None] - x[None]).sum(2) / (2 * c * c))
    np.fill_diagonal(w, 0.0)
    want = np.where(w > min_w, w, 0.0).sum(1)
    r = math.sqrt(-2 * c * c * math.log(min_w)) * (1 + 1e-9)
    got = {i: d for i, d in R.gaussian_degrees(points, c, min_w, r, **index).collect()}
    assert np.allclose([got.get(7 * i, 0.0) for i in range(400)], want)
    edges = G.kernel_edges(points, "gaussian", c, min_w=min_w)
    g = G.universal_ground(edges, points, 0.1, G.kernel_degrees(points, c, min_w=min_w))
    plain = G.universal_ground(edges, points, 0.1)
    assert not plain.edges.is_cached and not g.edges.is_cached
    assert g.total_w == pytest.approx(want.sum()) and plain.total_w == pytest.approx(want.sum())
    assert np.allclose(sorted(r["deg"] for r in g.nodes.collect()), sorted(want))


def test_chunks_of_cells_follow_the_rows(spark, wide, monkeypatch):
    """cells were cut into chunks of 4,096 rows at any size, and a query sent to each."""
    seen = []
    monkeypatch.setattr(N, "_CHUNKS", 2)
    real = F.ceil
    monkeypatch.setattr(N.F, "ceil", lambda c: seen.append(str(c)) or real(c))
    _, points = wide
    big = points.withColumn("id", F.explode(F.sequence(F.col("id") * 100, F.col("id") * 100 + 39)))
    N.knn_cells(big, big.where("id < 100"), 1, cells=2, probes=1)
    assert "4096" in seen[0]  # few rows: as before
    seen.clear()
    N.knn_cells(big.where("id < 0"), big, 1, cells=2, probes=1)
    assert "8000" in seen[0]


def test_batches_of_a_lot_are_taken_one_by_one(spark, tmp_path):
    """a micro-batch may hold many batches; the state is that of one micro-batch a batch, also after a restart."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    rows = [(int(i), x[i].tolist(), int(i % 9)) for i in rng.permutation(900)]
    rows += [r for r in rows if r[0] % 5 == 0]  # rows that come twice
    points = spark.createDataFrame(rows, "id long, x array<double>, b long")
    initial = [x[0].tolist(), x[1].tolist()]
    one = C.CentroidState(30, 0.0, 12.0, 0, [(i, v, 1) for i, v in enumerate(initial)])
    for b in range(9):
        one.take(points.where(F.col("b") == b).select("id", "x"), b, "id")
    for lot in range(2):
        points.where(F.floor(F.col("b") / 5) == lot).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ST.point_stream(spark, f"{tmp_path}/in", "id long, x array<double>, b long", files_per_trigger=100)
        state = ST.streaming_kmeans_stream(stream, initial, max_centroids=30, shift=0.0, z=12.0, path=str(tmp_path), numbered="b")
    assert [c[2] for c in state.centroids] == [c[2] for c in one.centroids]
    assert np.allclose([c[1] for c in state.centroids], [c[1] for c in one.centroids])
    assert state.total_n == one.total_n and state.mean_d2 == pytest.approx(one.mean_d2)
    assert spark.read.parquet(f"{tmp_path}/state/v*").count() == 2


def test_repeated_ids_at_the_cap_do_not_refine(spark):
    points = spark.createDataFrame([(i // 2, [float(i // 2)]) for i in range(40)], "id long, x array<double>")
    for room in (5, 6):
        by_plan = C.CentroidState(1 + room, -1.0, 1e-9, 0, [(0, [-3.0], 1)])
        by_plan.take(points, 0, "id")
        staged = C.CentroidState(1 + room, -1.0, 1e-9, 0, [(0, [-3.0], 1)])
        staged.take_staged(StagedPoints(points, F.lit(0)), 0, 40, 0, by_id=True)
        assert staged.centroids == by_plan.centroids and staged.total_n == by_plan.total_n


def test_centres_read_the_points_without_a_join(spark, monkeypatch):
    """the assignment carries its points, and medians sort a bracket of each cell; repeated ids count as in a join by id."""
    from potentia.operators import metrics as M
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(rng.integers(0, 9)), float(rng.normal()), float(rng.exponential())]) for i in range(3000)]
    rows += [rows[4], rows[4], rows[9]]
    points = spark.createDataFrame(rows, "id long, x array<double>")
    cents = spark.createDataFrame([(i, rows[i * 50][1]) for i in range(4)], "centroid_id long, x array<double>")
    for kind in M.DISTANCES:
        joined = points.join(M.nearest_by(points, cents, kind).select("id", "centroid_id"), "id").collect()
        got = {r["centroid_id"]: r for r in M.centres_by(points, M.nearest_by(points, cents, kind, with_x=True), kind, 3, M.repeated(points)).collect()}
        plain = {r["centroid_id"]: r for r in M.centres_by(points, M.nearest_by(points, cents, kind), kind, 3).collect()}
        assert set(got) == {r["centroid_id"] for r in joined} == set(plain)
        for c, r in got.items():
            x = np.array([j["x"] for j in joined if j["centroid_id"] == c])
            assert r["n"] == plain[c]["n"] == len(x) and np.allclose(r["x"], plain[c]["x"])
            if kind == "manhattan":
                assert np.allclose(r["x"], np.median(x, axis=0))
    unique = points.dropDuplicates(["id"])
    assert M.repeated(unique) is None
    plan = M.centres_by(unique, M.nearest_by(unique, cents, "cosine", with_x=True), "cosine", 3)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_medians_that_the_bracket_misses_are_ranked(spark, monkeypatch):
    from potentia.operators import metrics as M
    monkeypatch.setattr(M, "_BRACKET", -0.2)  # an empty bracket
    points = spark.createDataFrame([(i, [float(i * i), float(-i)]) for i in range(41)], "id long, x array<double>")
    cents = spark.createDataFrame([(0, [0.0, 0.0])], "centroid_id long, x array<double>")
    (r,) = M.centres_by(points, M.nearest_by(points, cents, "manhattan"), "manhattan", 2).collect()
    assert list(r["x"]) == [400.0, -20.0] and r["n"] == 41
