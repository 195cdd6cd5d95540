"""Solves in blocks: several parts, problems of their own and shared edges, and no plan a round."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from potentia.operators import blocks as B
from potentia.operators import graph as G
from potentia.operators import voltage as V


@pytest.fixture(scope="module")
def ring(spark):
    rng = np.random.default_rng(5)
    n = 60
    pairs = {(i, (i + 1) % n) for i in range(n)} | {tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(60)}
    rows = [(a, b, float(w)) for (a, b), w in zip(sorted(pairs), rng.uniform(0.5, 2.0, len(pairs)))]
    rows = [(i * 10 ** 12, j * 10 ** 12, w) for a, b, w in rows for i, j in ((a, b), (b, a))]
    edges = spark.createDataFrame(rows, "src long, dst long, w double").groupBy("src", "dst").agg(F.max("w").alias("w")).persist()
    nodes = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")).withColumn("g", F.lit(0.05)).persist()
    return G.Graph(edges, nodes, n, 1.0)


HELD = [(0, 0, 1.0), (3, 7, 1.0), (3, 30, -0.5)]


def dense(graph, held):
    nodes = {r["id"]: r["deg"] + r["g"] for r in graph.nodes.collect()}
    at = {i: k for k, i in enumerate(sorted(nodes))}
    m = np.diag([nodes[i] for i in sorted(nodes)])
    for r in graph.edges.collect():
        m[at[r["src"]], at[r["dst"]]] -= r["w"]
    fixed = {at[i]: v for i, v in held.items()}
    free = [k for k in range(len(m)) if k not in fixed]
    v = np.zeros(len(m))
    v[list(fixed)] = list(fixed.values())
    v[free] = np.linalg.solve(m[np.ix_(free, free)], -m[np.ix_(free, list(fixed))] @ v[list(fixed)])
    return {i: v[k] for i, k in at.items()}


@pytest.mark.parametrize("own", [False, True])
def test_exact_voltages_over_many_parts(spark, ring, own, monkeypatch):
    monkeypatch.setattr(B, "PART_SIZE", 50)
    monkeypatch.setattr(B, "CHECKPOINT_EVERY", 3)
    held = [(p, i * 10 ** 12, v) for p, i, v in HELD]
    lms = spark.createDataFrame(held, "problem_id int, id long, voltage double")
    graph = ring
    if own:
        both = F.explode(F.array(F.lit(0), F.lit(3))).alias("problem_id")
        graph = G.Graph(ring.edges.select("*", both), ring.nodes.select("*", both), ring.n, 1.0)
    got = {(r["problem_id"], r["id"]): r["v"] for r in V.conjugate_gradient(graph, lms, tol=1e-12).collect()}
    assert len(got) == 120
    for p in (0, 3):
        want = dense(ring, {i: v for q, i, v in held if q == p})
        assert max(abs(got[p, i] - v) for i, v in want.items()) < 1e-9


def test_a_round_starts_one_job_and_no_query(spark, ring, monkeypatch):
    monkeypatch.setattr(B, "CHECKPOINT_EVERY", 1 << 30)
    lms = spark.createDataFrame([(p, i * 10 ** 12, v) for p, i, v in HELD], "problem_id int, id long, voltage double")
    spark.sparkContext.setJobGroup("many-rounds", "")
    jobs = []
    try:
        for rounds in (2, 2, 12):  # the first also fills the caches
            before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many-rounds"))
            V.conjugate_gradient(ring, lms, tol=0.0, max_iters=rounds, partial=True)
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup("many-rounds")) - before)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[2] - jobs[1] == 10


def test_jacobi_over_many_parts(spark, ring, monkeypatch):
    monkeypatch.setattr(B, "PART_SIZE", 50)
    lms = spark.createDataFrame([(p, i * 10 ** 12, v) for p, i, v in HELD], "problem_id int, id long, voltage double")
    got = {(r["problem_id"], r["id"]): r["v"] for r in V.jacobi(ring, lms, max_iters=4, stop_when_growing=False).collect()}
    total = {r["id"]: r["deg"] + r["g"] for r in ring.nodes.collect()}
    edges = [tuple(r) for r in ring.edges.collect()]
    for p in (0, 3):
        held = {i * 10 ** 12: v for q, i, v in HELD if q == p}
        v = {i: held.get(i, 0.0) for i in total}
        for _ in range(4):
            new = dict.fromkeys(total, 0.0)
            for a, b, w in edges:
                new[a] += w * v[b]
            v = {i: held.get(i, new[i] / total[i]) for i in total}
        assert max(abs(got[p, i] - x) for i, x in v.items()) < 1e-12


def test_lanczos_steps_and_guttman_rounds_are_jobs_without_plans(spark):
    """A Lanczos step is two jobs and an iteration of MDS one, besides their checkpoints; none is planned."""
    from potentia.operators import embed as E, spectral as SP
    sc = spark.sparkContext
    edges = spark.createDataFrame([(i, (i + s) % 80, 1.0) for i in range(80) for s in (1, 79)], "src long, dst long, w double").persist()
    nodes = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")).persist()
    points = spark.createDataFrame([(i, [float(i % 5), float(i * i % 7), float(i % 3)]) for i in range(30)], "id long, x array<double>")
    points.count(), nodes.count()

    def lanczos(n):
        with pytest.raises(V.NotConverged):
            SP.laplacian_eigenvectors(edges, nodes, 2, max_steps=n, tol=0.0)

    def jobs(run, n):
        group = f"{run.__name__}-{n}"
        sc.setJobGroup(group, "")
        run(n)
        return len(sc.statusTracker().getJobIdsForGroup(group))

    def mds(n):
        E.mds_2d(points, iters=n, eps=0.0)

    try:
        lanczos(1), mds(1)
        assert jobs(lanczos, 9) - jobs(lanczos, 3) <= 6 * 2
        assert jobs(mds, 8) - jobs(mds, 2) <= 6
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_guttman_rounds_against_numpy(spark, monkeypatch):
    from potentia.operators import embed as E
    monkeypatch.setattr(E, "PART_PAIRS", 200)  # several parts
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    x[7] = x[6]  # a distance of 0
    points = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    y = np.array([r["y"] for r in E.pca_2d(points).orderBy("id").collect()])
    delta = np.sqrt(np.square(x[:, None] - x[None]).sum(2))
    for _ in range(15):
        diff = y[:, None] - y[None]
        dd = np.sqrt(np.square(diff).sum(2))
        ratio = np.divide(delta, dd, out=np.zeros_like(dd), where=dd > 0)
        y = (ratio[:, :, None] * diff).sum(1) / 40
    got = {r["id"]: r["y"] for r in E.mds_2d(points, iters=15, eps=0.0).collect()}
    assert np.allclose([got[3 * i] for i in range(40)], y, atol=1e-9)


def test_eigenvectors_count_a_node_that_comes_twice(spark):
    """A repeated node keeps its rows and its weight in every inner product."""
    from potentia.operators import spectral as SP
    edges = spark.createDataFrame([(i, (i + s) % 12, 1.0) for i in range(12) for s in (1, 11)], "src long, dst long, w double")
    ids = spark.createDataFrame([(i,) for i in [*range(12), 3]], "id long")
    nodes = ids.select("id", F.lit(2.0).alias("deg"))
    _, y = SP.laplacian_eigenvectors(edges, nodes, 3)
    rows = [(r["id"], tuple(r["y"])) for r in y.collect()]
    assert sorted(i for i, _ in rows) == sorted([*range(12), 3])
    m = np.array([v for _, v in rows])
    assert np.allclose(m.T @ m, np.eye(3), atol=1e-8)
