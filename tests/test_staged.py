"""Streams staged once in their order: what a batch reads, and what it costs."""

import numpy as np
from pyspark.sql import functions as F

from potentia.operators import cluster as C
from potentia.operators import staged as ST


def _points(spark, n, d=2, seed=3):
    x = np.random.default_rng(seed).random((n, d))
    return x, spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, x array<double>")


def test_rows_of_a_batch_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(ST, "PART_ROWS", 30)
    x, df = _points(spark, 400)
    st = ST.StagedPoints(df, -F.col("id"))
    assert st.n == 400 and len(st.starts) > 10
    for lo, hi in [(0, 400), (25, 111), (398, 500), (7, 8), (400, 410)]:
        got = [(i, tuple(v), r) for ids, xs, rows in st.run(lo, hi, lambda ids, named, x, rows: (ids, x, rows)) for i, v, r in zip(ids, xs, rows)]
        want = [(399 - r, tuple(x[399 - r]), r) for r in range(lo, min(hi, 400))]
        assert got == want
        assert [(r.id, tuple(r.x), r.row_id) for r in st.rows(lo, hi).orderBy("row_id").collect()] == want


def test_a_batch_is_one_job(spark):
    _, df = _points(spark, 900)
    df = df.persist()
    sc = spark.sparkContext

    def jobs(n, run):
        group = f"staged-{run.__name__}-{n}"
        sc.setJobGroup(group, group)
        run(df.where(F.col("id") < n))
        sc.setJobGroup("rest", "rest")
        return len(sc.statusTracker().getJobIdsForGroup(group))

    def kmeans(p):
        C.streaming_kmeans(p, max_centroids=5, init_size=100, batch_size=20, seed_rows=5)

    def minibatch(p):
        cents = spark.createDataFrame([(0, [0.1, 0.1], 1), (1, [0.9, 0.9], 1)], "centroid_id long, x array<double>, n long")
        C.minibatch(p, 2, 1, 0, 2, batch_size=20, cents=cents)

    for run in (kmeans, minibatch):  # 20 batches more; seeding may end in a batch more or less
        assert jobs(900, run) - jobs(500, run) <= 24
