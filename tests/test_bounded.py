"""What a step holds at once, reads again or sends whole, on rows made here."""

import glob

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from potentia.operators import cluster as C
from potentia.operators import graph as G
from potentia.operators import neighbors as N


def _df(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, x array<double>")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_leave_their_group_in_pieces(spark, monkeypatch):
    x = np.random.default_rng(0).random((2000, 2))
    group = pa.table({"id": np.arange(2000), "x": x.tolist(), "_own": np.zeros(2000, np.int32), "_a": np.zeros(2000, np.int32),
                      "_b": np.zeros(2000, np.int32)}).to_batches(max_chunksize=300)
    sizes = [b.num_rows for b in N._pairs_group(iter(group), None)]
    assert sum(sizes) == 2000 * 1999 // 2 and max(sizes) <= N._BLOCK_CELLS
    monkeypatch.setattr(N, "_PAIR_BLOCK", 100)
    some = _df(spark, x[:450])
    got, want = (sorted(map(tuple, N.all_pairs(some, max_points=m).collect())) for m in (10, 1000))
    assert got == want and len(got) == 450 * 449 // 2


@pytest.mark.parametrize("d", [3, 64])
def test_extremes_with_copies(spark, monkeypatch, d):
    x = np.random.default_rng(d).normal(size=(300, d))
    x[250:] = x[:50]  # exact copies: their distance 0 does not count
    x[249] = x[0] + 1e-7
    d2 = N._sq_dists(x, x)
    want = (d2[d2 > 0].min(), d2.max())
    df = _df(spark, x)
    monkeypatch.setattr(N, "_PAIR_BLOCK", 100)
    assert all(tuple(N.pairwise_min_max(df, max_points=m).first()) == want for m in (10, 1000))


def test_far_pairs_are_not_summed_again(monkeypatch):
    x = np.random.default_rng(1).normal(size=(500, 64))
    monkeypatch.setattr(N, "_sq_dists", None)  # the sums of all pairs are not asked for
    assert np.isfinite(N._extremes(x, x, np.eye(500, dtype=bool), np.inf, -np.inf)).all()


def test_row_sums_send_no_edges_to_the_driver(spark):
    edges = G.kernel_edges(_df(spark, np.random.default_rng(2).random((40, 1))).withColumn("weight", F.lit(1.0)), "gaussian", 0.5, min_w=0.01)
    rows = G.row_stochastic(edges)
    assert "Broadcast" not in _plan(rows)
    sums = rows.groupBy("src").agg(F.sum("w").alias("s")).collect()
    assert len(sums) == 40 and all(r.s == pytest.approx(1.0) for r in sums)


def test_grid_join_sends_no_probes_to_the_driver(spark):
    x = np.random.default_rng(3).random((200, 2))
    near = N.radius_join_grid(_df(spark, x), 0.1)
    assert "Broadcast" not in _plan(near)
    d2 = N._sq_dists(x, x)
    assert {(r.id1, r.id2) for r in near.collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(d2 <= 0.1 * 0.1)) if i < j}


@pytest.mark.parametrize("step", [lambda p: C.kmeans_pp(p, 7, 3).collect(), lambda p: C.intrinsic_dimension(p, 2, [2, 4, 8], 5).collect()])
def test_input_is_read_once(spark, step):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    step(_df(spark, np.random.default_rng(4).random((300, 2))).mapInPandas(count, "id long, x array<double>"))
    assert read.value == 300


def test_streamed_files_stay_small(spark, monkeypatch):
    from potentia.plans import catalog
    from potentia.streaming import stream as ST
    seen, plain = [], ST.point_stream

    def noted(spark, path, **kw):
        seen.append((path, kw["files_per_trigger"]))
        return plain(spark, path, **kw)

    monkeypatch.setattr(ST, "point_stream", noted)
    monkeypatch.setattr(catalog, "_T4_ROWS", 1000)
    sf = "/root/testdata/sf0.001"
    rows = catalog.li(spark, sf).count()
    files = 4 * -(-rows // 1000)
    assert catalog.QUERIES["stream_assign_T4_T5"](spark, sf).count() == rows
    (path, a_batch), = seen
    assert a_batch == files // 4 and len(glob.glob(f"{path.removeprefix('file:')}/*.parquet")) == files
