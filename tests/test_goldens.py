"""Golden values (FIXTURES.md section 3) for distances, graphs, solvers, losses and search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import pts_1d
from potentia.functions import vec
from potentia.operators import cluster as C, graph as G, tune as TU, voltage as V
from potentia.operators.graph import Graph


def _v(df):
    return [r["v"] for r in df.orderBy("id").collect()]


def test_distances_G_a(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0], [2.0, 2.0, 2.0]), ([2.0, 2.0, 2.0], [3.0, 3.0, 3.0]), ([1.0, 1.0, 1.0], [3.0, 3.0, 3.0])],
                               "a array<double>, b array<double>")
    r = df.select(vec.sq_dist("a", "b").alias("d2"), vec.manhattan("a", "b").alias("l1"),
                  vec.chebyshev("a", "b").alias("linf"), vec.cosine_distance("a", "b").alias("cos")).collect()
    assert [x.d2 for x in r] == [3.0, 3.0, 12.0]
    assert [x.l1 for x in r] == [3.0, 3.0, 6.0]
    assert [x.linf for x in r] == [1.0, 1.0, 2.0]
    assert all(abs(x.cos) < 1e-12 for x in r)


def test_three_node_circuit_G_b(spark):
    # conductances chosen so that w/(deg+g) reproduces A=[[0,1/3,0],[1/3,0,2/3],[0,2/3,0]], b=[0,0,1/3]
    e = [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0)]
    edges = spark.createDataFrame(e + [(b, a, w) for a, b, w in e], "src long, dst long, w double")
    nodes = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 0.0), (2, 3.0, 0.0), (3, 1.0, 0.0)],
                                  "id long, deg double, g double")
    lm = spark.createDataFrame([(0, 3, 1.0)], "problem_id int, id long, voltage double")
    v = _v(V.conjugate_gradient(Graph(edges, nodes, 4, 0.0), lm))
    assert np.allclose(v[:3], [1 / 6, 1 / 2, 2 / 3], atol=1e-10)


@pytest.mark.parametrize("k,r,n_edges,w,g,expected", [
    (1, 1.0, 6, 0.0625, 0.0234375, [0.24963432, 0.34324720, 0.56557777, 1]),
    (2, 1.0, 10, 0.03125, 0.01953125, [0.40894569, 0.53674121, 0.53674121, 1]),
    (2, 10.0, 10, 0.03125, 0.001953125, [0.88734835, 0.91507799, 0.91507799, 1]),
    (2, 0.1, 10, 0.03125, 0.1953125, [0.03027436, 0.12488174, 0.12488174, 1]),
])
def test_knn_graph_G_c(spark, k, r, n_edges, w, g, expected):
    graph = G.knn_graph(pts_1d(spark, [0, 1, 2, 3]), k, r)
    ed = graph.edges.collect()
    assert len(ed) == n_edges
    assert all(abs(x.w - w) < 1e-15 for x in ed)
    assert {(x.src, x.dst) for x in ed} == {(x.dst, x.src) for x in ed}  # symmetric (G-j)
    assert abs(graph.nodes.first()["g"] - g) < 1e-15
    lm = spark.createDataFrame([(0, 3, 1.0)], "problem_id int, id long, voltage double")
    assert np.allclose(_v(V.conjugate_gradient(graph, lm)), expected, atol=1e-7)


def test_jacobi_converges_to_exact(spark):
    graph = G.knn_graph(pts_1d(spark, [0, 1, 2, 3]), 2, 0.1)
    lm = spark.createDataFrame([(0, 3, 1.0)], "problem_id int, id long, voltage double")
    got = _v(V.jacobi(graph, lm, max_iters=60, stop_when_growing=False))
    assert np.allclose(got, [0.03027436, 0.12488174, 0.12488174, 1], atol=1e-6)


def test_two_landmarks_G_c(spark):
    graph = G.knn_graph(pts_1d(spark, [0, 1, 2, 3]), 2, 1.0)
    lm = spark.createDataFrame([(0, 0, 0.0), (0, 3, 1.0)], "problem_id int, id long, voltage double")
    assert np.allclose(_v(V.conjugate_gradient(graph, lm)), [0, 0.38095238, 0.38095238, 1], atol=1e-7)


@pytest.mark.parametrize("r,g,expected", [
    (1.0, 1.041020e-6, [0.001772, 0.028231, 0.866989, 1, 0.866989, 0.028231, 0.001772]),
    (10.0, 1.041020e-7, [0.212246, 0.354560, 0.956856, 1, 0.956856, 0.354560, 0.212246]),
    (0.1, 1.041020e-5, [0.000000, 0.000014, 0.638920, 1, 0.638920, 0.000014, 0.000000]),
])
def test_grid_line_G_d(spark, r, g, expected):
    from potentia.sources import generators as GN
    ids = spark.range(99)
    pts = GN.over(ids, GN.grid_1d(99), 0)
    graph = G.knn_graph(pts, 2, r)
    assert graph.edges.count() == 200
    assert abs(graph.nodes.first()["g"] - g) / g < 1e-5
    lm = spark.createDataFrame([(0, 49, 1.0)], "problem_id int, id long, voltage double")
    v = _v(V.conjugate_gradient(graph, lm, tol=1e-13))
    got = [v[i] for i in (0, 24, 48, 49, 50, 74, 98)]
    assert np.allclose(got, expected, atol=2e-6)
    assert all(0.0 <= x <= 1.0 + 1e-12 for x in v)  # maximum principle (G-j)


def _gauss_graph(spark, c, p_g):
    pts = pts_1d(spark, [0, 1, 2, 3])
    e = G.kernel_edges(pts, "gaussian", c)
    deg = e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg"))
    nodes = deg.select("id", "deg", (F.lit(p_g / 4) * F.col("deg")).alias("g"))
    return e, Graph(e, nodes, 4, 0.0)


def test_gaussian_jacobi_G_e(spark):
    e, graph = _gauss_graph(spark, 1.0, 0.1)
    sums = [r["s"] for r in e.groupBy("src").agg(F.sum("w").alias("s")).orderBy("src").collect()]
    assert np.allclose(sums, [0.75297494, 1.34839660, 1.34839660, 0.75297494], atol=1e-8)
    lm = spark.createDataFrame([(0, 3, 1.0)], "problem_id int, id long, voltage double")
    rounds = {1: [0.01439363, 0.09791958, 0.43884509, 1], 2: [0.16829692, 0.29682116, 0.48322603, 1],
              3: [0.33238908, 0.38383722, 0.58558316, 1]}
    for it, exp in rounds.items():
        assert np.allclose(_v(V.jacobi(graph, lm, max_iters=it, stop_when_growing=False)), exp, atol=1e-8)
    assert np.allclose(_v(V.conjugate_gradient(graph, lm)), [0.85859907, 0.87215607, 0.90566016, 1], atol=1e-8)


def test_literal_rescale_G_f(spark):
    pts = pts_1d(spark, [0, 1, 2, 3])
    e = G.kernel_edges(pts, "gaussian", 0.5)
    before = [r["s"] for r in e.groupBy("src").agg(F.sum("w").alias("s")).orderBy("src").collect()]
    assert np.allclose(before, [0.13567076, 0.27100603, 0.27100603, 0.13567076], atol=1e-8)
    after = G.literal_rescale(e)
    s = [r["s"] for r in after.groupBy("src").agg(F.sum("w").alias("s")).orderBy("src").collect()]
    assert np.allclose(s, [0.86432924, 0.72899397, 0.72899397, 0.86432924], atol=1e-8)
    with pytest.raises(Exception):
        G.literal_rescale(G.kernel_edges(pts, "gaussian", 1.0)).collect()


def test_row_stochastic_sums_to_one(spark):
    e = G.row_stochastic(G.kernel_edges(pts_1d(spark, [0, 1, 2, 3]), "gaussian", 1.0))
    s = [r["s"] for r in e.groupBy("src").agg(F.sum("w").alias("s")).collect()]
    assert np.allclose(s, 1.0)


GG = [
    ([0] + [1] * 9, [1.586984, 1.872941, 0.5, 0.1, 0.333333, 6.243136]),
    ([0] * 9 + [1], [1.586984, 1.217297, 0.5, 0.1, 0.333333, 4.057658]),
    ([0.1] * 9 + [1], [1.344812, 0.976945, 0.4, 0.0, 0.0, 3.618316]),
    ([0.2 * i / 9 for i in range(9)] + [1], [1.269587, 0.904629, 0.388889, 0.1, 0.358808, 3.245881]),
    ([2 ** (0.2 * i / 9) - 1 for i in range(9)] + [1], [1.355836, 0.988966, 0.419940, 0.1, 0.352684, 3.487927]),
]


@pytest.mark.parametrize("values,expected", GG)
def test_losses_G_g(spark, values, expected):
    v = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(values)], "problem_id int, id long, v double")
    r = TU.losses(v).first()
    got = [r["n_inf_uniform"], r["n_inf_exp"], r["median"], r["minimum"], r["min_with_std"], r["exp_with_std"]]
    assert np.allclose(got, expected, atol=2e-6)


def test_running_mean_G_h(spark):
    cents = spark.createDataFrame([(0, [0.0], 1), (1, [10.0], 1)], "centroid_id long, x array<double>, n long")
    batch = pts_1d(spark, [1, 2, 9])
    r = C.refine(batch, cents, 1).orderBy("centroid_id").collect()
    assert np.isclose(r[0]["x"][0], 1.0) and r[0]["n"] == 3
    assert np.isclose(r[1]["x"][0], 9.5) and r[1]["n"] == 2
    assert np.isclose(sum(x["batch_d2"] for x in r) / sum(x["batch_n"] for x in r), 2.0)


def test_bisection_G_i(spark):
    graph = G.knn_graph(pts_1d(spark, [0, 1, 2, 3]), 1, 1.0)
    lm = spark.createDataFrame([(3, 1.0)], "id long, voltage double")
    res = TU.ground_search(graph, lm, target=0.7, accuracy=0.01, radius=1, r_min=0.01, r_max=100)
    tries = res.tries.orderBy("try").collect()
    assert np.allclose([t["r"] for t in tries], [1, 0.1, 0.316228, 0.562341, 0.421697], atol=1e-6)
    assert np.allclose([t["mean_v"] for t in tries], [0.782789, 0.589775, 0.677347, 0.729038, 0.702796], atol=1e-6)
    assert math.isclose(res.best, 0.421697, abs_tol=1e-6)


def test_ground_resistance_must_be_positive(spark):
    with pytest.raises(ValueError):
        G.knn_graph(pts_1d(spark, [0, 1, 2]), 1, 0.0)


def test_zero_total_weight_raises(spark):
    from potentia.operators import points as P
    with pytest.raises(ValueError):
        P.normalize_weights(pts_1d(spark, [0, 1], weights=[0.0, 0.0]))


def test_negative_inputs(spark):
    from potentia.operators import points as P
    pts = pts_1d(spark, [0, 1, 2])
    for kw in ({"max_centroids": 0}, {"init_size": 0}, {"batch_size": -1}):
        with pytest.raises(ValueError):
            C.streaming_kmeans(pts, **kw)
    mixed = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, x array<double>")
    with pytest.raises(ValueError):
        P.dimension(mixed)


def test_rank_in_groups_matches_window(spark):
    """Distributed ranks (range partition + in-partition positions) equal a window rank."""
    from pyspark.sql import Window
    from potentia.operators.ranking import quantile, rank_in_groups
    rng = np.random.default_rng(3)
    rows = [(int(g), int(i), float(np.round(v, 1))) for i, (g, v) in enumerate(zip(rng.integers(0, 4, 3000),
                                                                                  rng.random(3000)))]
    df = spark.createDataFrame(rows, "g int, id long, v double").repartition(7)
    for order in (["v", "id"], [F.col("v").desc(), F.col("id").desc()]):
        got = rank_in_groups(df, order, ["g"], parts=6)
        w = Window.partitionBy("g").orderBy(*[F.col(o) if isinstance(o, str) else o for o in order])
        exp = df.withColumn("_rank", (F.row_number().over(w) - 1).cast("long"))
        assert got.select("id", "_rank").exceptAll(exp.select("id", "_rank")).count() == 0
        assert got.select("_n").distinct().count() == 4  # one size per group
    q = {r["g"]: r["q"] for r in quantile(df, "v", 0.5, ["g"]).collect()}
    for gi in range(4):
        vals = np.array([v for g, _, v in rows if g == gi])
        assert np.isclose(q[gi], np.quantile(vals, 0.5))
