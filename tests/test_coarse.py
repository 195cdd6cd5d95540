"""Two-level preconditioner of the exact solver: dense solutions, and fewer rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from potentia.operators import coarse as K
from potentia.operators import graph as G
from potentia.operators import voltage as V


def dense(graph, landmarks):
    """{problem: {id: v}} from a dense solve of the free nodes' equations."""
    nodes = {r["id"]: r["deg"] + r["g"] for r in graph.nodes.collect()}
    ids = sorted(nodes)
    at = {i: n for n, i in enumerate(ids)}
    m = np.diag([nodes[i] for i in ids])
    for r in graph.edges.collect():
        m[at[r["src"]], at[r["dst"]]] -= r["w"]
    out = {}
    for p in sorted({p for p, _, _ in landmarks}):
        held = {i: v for q, i, v in landmarks if q == p}
        free = [at[i] for i in ids if i not in held]
        fixed = [at[i] for i in held]
        v = np.zeros(len(ids))
        v[fixed] = list(held.values())
        v[free] = np.linalg.solve(m[np.ix_(free, free)], -m[np.ix_(free, fixed)] @ v[fixed])
        out[p] = dict(zip(ids, v))
    return out


def square(spark, n, r=50.0):
    """Points of a square, each tied to its 6 nearest: current takes many hops."""
    rng = np.random.default_rng(3)
    xs = rng.uniform(0, n ** 0.5, (n, 2))
    pts = spark.createDataFrame([(i, [float(a) for a in x], 1.0) for i, x in enumerate(xs)],
                                "id long, x array<double>, weight double").coalesce(2).persist()
    return pts, G.knn_graph(pts, 6, r).persist()


@pytest.fixture(scope="module")
def big(spark):
    return square(spark, 160)


@pytest.fixture(scope="module")
def small(spark):
    return square(spark, 40)


LANDMARKS = [(0, 0, 1.0), (7, 5, 1.0), (7, 6, -0.5), (7, 31, 0.25), (9, 20, 2.0)]


def solved(spark, graph, cells, within=1e-8, **kw):
    lms = spark.createDataFrame(LANDMARKS, "problem_id int, id long, voltage double")
    got = V.conjugate_gradient(graph, lms, cells=cells, **{"tol": 1e-11, **kw}).collect()
    want = dense(graph, LANDMARKS)
    assert len(got) == sum(len(v) for v in want.values())
    for r in got:
        assert abs(r["v"] - want[r["problem_id"]][r["id"]]) < within


def plain_rounds(graph, landmark, tol):
    """Rounds of Jacobi-preconditioned conjugate gradient, one landmark at 1 V."""
    nodes = {r["id"]: r["deg"] + r["g"] for r in graph.nodes.collect()}
    m = np.diag([nodes[i] for i in range(len(nodes))])
    for r in graph.edges.collect():
        m[r["src"], r["dst"]] -= r["w"]
    free = np.arange(len(nodes)) != landmark
    a, b = m[np.ix_(free, free)], -m[free, landmark]
    x, r, d, rounds = np.zeros(len(b)), b.copy(), np.diag(m)[free], 0
    z = r / d
    p, rz = z, r @ z
    while np.linalg.norm(r) > tol * np.linalg.norm(b):
        q = a @ p
        step = rz / (p @ q)
        x, r = x + step * p, r - step * q
        z = r / d
        p, rz, rounds = z + (r @ z) / rz * p, r @ z, rounds + 1
    return rounds


def test_rounds_and_solution(spark, big):
    pts, graph = big
    rounds = []
    solved(spark, graph, K.around(pts, 40), 1e-6, tol=1e-8, trace=rounds)
    assert rounds[0] * 4 < plain_rounds(graph, 0, 1e-8) * 3


def test_odd_cells(spark, small):
    """Nodes without a cell, with two or with a null one, and cells of nodes that do not exist."""
    pts, graph = small
    cells = (pts.where("id % 3 > 0").select("id", (F.col("id") % 5).alias("centroid_id"))
             .unionByName(pts.where("id < 4").select("id", F.lit(77).cast("long").alias("centroid_id")))
             .unionByName(pts.where("id = 5").select("id", F.lit(78).cast("long").alias("centroid_id")))
             .unionByName(pts.where("id = 1").select((F.col("id") + 5000).alias("id"), F.lit(79).cast("long").alias("centroid_id")))
             .unionByName(pts.where("id = 9").select("id", F.lit(None).cast("long").alias("centroid_id"))))
    solved(spark, graph, cells)


def test_no_cells_at_all(spark, small):
    pts, graph = small
    solved(spark, graph, pts.where("false").select("id", F.col("id").alias("centroid_id")))


def test_merged_cells(spark, big):
    """More cells than the driver may hold are merged; the matrix is the dense one's."""
    pts, graph = big
    lms = spark.createDataFrame(LANDMARKS, "problem_id int, id long, voltage double")
    space = K.CoarseSpace(graph, lms, pts.select("id", F.col("id").alias("centroid_id")), [0, 7, 9], max_bytes=8 * 3 * 10 * 10)
    assert space.k == 10
    of = {r["id"]: r["_z"] for r in space.numbered.collect()}
    assert len(of) == 160 and set(of.values()) == set(range(10))
    nodes = {r["id"]: r["deg"] + r["g"] for r in graph.nodes.collect()}
    for p in (0, 7, 9):
        held = {i for q, i, _ in LANDMARKS if q == p}
        want = np.zeros((10, 10))
        for i, w in nodes.items():
            if i not in held:
                want[of[i], of[i]] += w
        for r in graph.edges.collect():
            if not {r["src"], r["dst"]} & held:
                want[of[r["src"]], of[r["dst"]]] -= r["w"]
        assert np.allclose(space.inverse[p] @ want, np.eye(10), atol=1e-8)
    space.release()


def test_no_ground_and_graphs_by_problem(spark, small):
    pts, graph = small
    bare = G.with_ground(graph.edges, pts.select("id"), None, universal_ground=False)
    scaled = F.explode(F.array(F.lit(0), F.lit(7), F.lit(9))).alias("problem_id")
    each = G.Graph(bare.edges.select("*", scaled).withColumn("w", F.col("w") * (F.col("problem_id") + 1)),
                   bare.nodes.select("id", "deg", "g", scaled).withColumn("deg", F.col("deg") * (F.col("problem_id") + 1)),
                   bare.n, bare.total_w)
    lms = spark.createDataFrame(LANDMARKS, "problem_id int, id long, voltage double")
    want = dense(bare, LANDMARKS)  # a graph scaled as a whole has the same voltages
    got = V.conjugate_gradient(each, lms, tol=1e-11, cells=K.around(pts, 8)).collect()
    assert len(got) == 120 and all(abs(r["v"] - want[r["problem_id"]][r["id"]]) < 1e-7 for r in got)
