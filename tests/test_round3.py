"""Mini-batch updates, graph reset, saved models, landmark restriction, odd problem ids."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from potentia.operators import cluster as C
from potentia.operators import evaluate as EV
from potentia.operators import graph as G
from potentia.operators import voltage as V
from potentia.sources import sinks


def points(spark, n=90, d=3, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("head, size", [(0, 20), (10, 7), (10, 1000)])
def test_minibatch_updates_by_batch(spark, head, size):
    x, df = points(spark)
    cents = spark.createDataFrame([(c, [float(v) for v in x[c]], 1) for c in range(4)], "centroid_id long, x array<double>, n long")
    got = {r.centroid_id: (r.n, r.x) for r in C.minibatch(df, 4, 0, head, 3, order_key=F.col("id"), batch_size=size, cents=cents).collect()}
    mat, n = x[:4].copy(), np.ones(4)
    for s in range(head, len(x), size):
        batch = x[s:s + size]
        own = np.square(batch[:, None] - mat[None]).sum(2).argmin(1)
        for c in range(4):
            some = batch[own == c]
            mat[c] = (mat[c] * n[c] + some.sum(0)) / (n[c] + len(some))
            n[c] += len(some)
    assert [got[c][0] for c in range(4)] == n.tolist() and np.allclose([got[c][1] for c in range(4)], mat)


def test_minibatch_fits_its_head_first(spark):
    _, df = points(spark, n=200)
    got = C.minibatch(df, 5, 1, 50, 3).collect()
    assert len(got) == 5 and sum(r.n for r in got) == 200


def test_graph_reset(spark):
    _, df = points(spark, n=30)
    g = G.knn_graph(df.withColumn("weight", F.lit(1.0)), 3, 0.1)
    twice = G.reset(g, edges=g.edges.withColumn("w", F.col("w") * 2))
    a, b = ({r.id: (r.deg, r.g) for r in x.nodes.collect()} for x in (g, twice))
    assert twice.total_w == pytest.approx(2 * g.total_w)
    assert all(b[i] == pytest.approx((2 * a[i][0], 2 * a[i][1])) for i in a)
    assert {r.g for r in G.reset(g, g=0.25).nodes.collect()} == {0.25}
    table = spark.createDataFrame([(3, 1.5)], "id long, g double")
    tied = {r.id: r.g for r in G.reset(g, g=table).nodes.collect()}
    assert tied[3] == 1.5 and sum(tied.values()) == 1.5 and len(tied) == 30


def test_model_round_trip(spark, tmp_path):
    x, df = points(spark)
    cents = C.lloyd(df, 3, 1, weight=None)
    sinks.write_model(cents, str(tmp_path / "m"), {"seed": 1, "note": "é"})
    back, settings = sinks.read_model(spark, str(tmp_path / "m"))
    assert settings == {"k": 3, "dim": 3, "seed": 1, "note": "é"}
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cents.select("centroid_id", "x", "n").collect()))
    spark.createDataFrame([(json.dumps({**settings, "k": 4}),)], "value string").write.mode("overwrite").text(str(tmp_path / "m" / "settings"))
    with pytest.raises(ValueError, match="4 centroids"):
        sinks.read_model(spark, str(tmp_path / "m"))


def test_restriction_to_labels_and_landmarks(spark):
    v = spark.createDataFrame([(p, i, p + i / 10) for p in range(3) for i in range(4)], "problem_id int, id long, v double")
    pts = spark.createDataFrame([(i, i % 2) for i in range(4)], "id long, label int")
    got = sorted((r.problem_id, r.id, r.label) for r in EV.restricted(v, pts, [1], [0, 2]).collect())
    assert got == [(0, 1, 1), (0, 3, 1), (2, 1, 1), (2, 3, 1)]


def test_problem_ids_beyond_an_int(spark):
    big = 1 << 40
    e = [(i, i + 1, 1.0) for i in range(4)]
    edges = spark.createDataFrame(e + [(b, a, w) for a, b, w in e], "src long, dst long, w double")
    nodes = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")).withColumn("g", F.lit(0.1))
    held = spark.createDataFrame([(big, 0, 1.0), (big + 1, 4, 1.0)], "problem_id long, id long, voltage double")
    v = {(r.problem_id, r.id): r.v for r in V.conjugate_gradient(G.Graph(edges, nodes, 5, 8.0), held).collect()}
    assert len(v) == 10 and all(v[big, i] == pytest.approx(v[big + 1, 4 - i]) for i in range(5))
