"""Readers, writers and streaming (S1-S8, S11, K1-K6, T1-T5): file round trips and
stream == batch."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from potentia.operators import cluster as C, neighbors as N
from potentia.sources import sinks, vectors
from potentia.streaming import stream as ST


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_text_vector_lines(spark, tmp_path):
    p = _write(tmp_path / "v.txt", "the 1.0 2.0\na  3  4\nbad x 2\none\n")
    got = {r["label"]: list(r["x"]) for r in vectors.read_vectors(spark, p).collect()}
    assert got == {"the": [1.0, 2.0], "a": [3.0, 4.0]}  # bad float skipped, short row dropped
    with pytest.raises(Exception):
        vectors.read_vectors(spark, p, mode="FAILFAST").collect()


def test_csv_split_char_and_header(spark, tmp_path):
    p = _write(tmp_path / "m.csv", "label,1x1,1x2,1x3\n5,0,128,255\n")
    got = vectors.read_vectors(spark, p, split_char=",").collect()
    assert [(r["label"], list(r["x"])) for r in got] == [("5", [0.0, 128.0, 255.0])]
    d = vectors.read_csv_labelled(spark, p).collect()
    assert d[0]["label"] == "5" and list(d[0]["x"]) == [0.0, 128.0, 255.0]


def test_fixed_width_and_head(spark, tmp_path):
    p = _write(tmp_path / "w.txt", "a 1 2\nb 1 2 3\nc 4 5\nd 6 7\n")
    got = [r["label"] for r in vectors.read_vectors(spark, p, width=2).orderBy("row_id").collect()]
    assert got == ["a", "c", "d"]
    rows = vectors.read_vectors(spark, p)
    assert [r["label"] for r in vectors.head(rows, 2).orderBy("row_id").collect()] == ["a", "b"]
    b = vectors.batches(rows, 3).groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [r["count"] for r in b] == [3, 1]


def test_point_document_lineten(spark, tmp_path):
    # the four integer points 0, 1, 2, 3 of the small line sample, with the declared length
    p = _write(tmp_path / "lineten.json", json.dumps({"data": [[0], [1], [2], [3]], "length": 4}))
    pts = vectors.read_point_file(spark, p).orderBy("id").collect()
    assert [list(r["x"]) for r in pts] == [[0.0], [1.0], [2.0], [3.0]]
    bad = _write(tmp_path / "bad.json", json.dumps({"data": [[0], [1]], "length": 3}))
    with pytest.raises(ValueError):
        vectors.read_point_file(spark, bad)


def test_point_stream_file(spark, tmp_path):
    p = _write(tmp_path / "s.json", '{"data": [\n[0.5, 1.0],\n[2.0, 3.5],\n[4, 5]\n],\n"length": 3}\n')
    pts = vectors.read_point_stream_file(spark, p).orderBy("id").collect()
    assert [list(r["x"]) for r in pts] == [[0.5, 1.0], [2.0, 3.5], [4.0, 5.0]]


def test_bare_array_file(spark, tmp_path):
    p = _write(tmp_path / "b.json", "[[-40.96, 29.75], [1.5, -2.0], [3, 4]]")
    pts = vectors.read_bare_array_file(spark, p).orderBy("id").collect()
    assert [list(r["x"]) for r in pts] == [[-40.96, 29.75], [1.5, -2.0], [3.0, 4.0]]


def test_sinks_round_trip(spark, tmp_path):
    pts = spark.createDataFrame([(i, [float(i), float(2 * i)], "w%d" % i) for i in range(5)],
                                "id long, x array<double>, label string")
    for ext in (".txt", ".json", ".parquet"):
        path = str(tmp_path / f"pts{ext}")
        sinks.write_points(pts, path)
        back = sinks.read_points(spark, path)
        xs = sorted(tuple(r["x"]) for r in back.collect())
        assert xs == sorted(tuple(r["x"]) for r in pts.collect())
    cents = spark.createDataFrame([(0, [1.0], 3)], "centroid_id long, x array<double>, n long")
    sinks.write_centroids(cents, str(tmp_path / "c"))
    assert vectors.read_centroids(spark, str(tmp_path / "c")).first()["n"] == 3
    v = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.25)], "problem_id int, id long, v double")
    sinks.write_voltages(v, str(tmp_path / "v"))
    assert {"problem_id=0", "problem_id=1"} <= set(os.listdir(tmp_path / "v"))


def test_shuffled_text_is_a_permutation(spark, tmp_path):
    lines = spark.createDataFrame([(f"line {i}",) for i in range(200)], "value string")
    sinks.write_shuffled_text(lines, str(tmp_path / "sh"), seed=3)
    back = [r["value"] for r in spark.read.text(str(tmp_path / "sh")).collect()]
    assert sorted(back) == sorted(f"line {i}" for i in range(200))
    assert back != [f"line {i}" for i in range(200)]


def test_stream_assignment_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.random((300, 2)))],
                                "id long, x array<double>")
    src = str(tmp_path / "src")
    pts.repartition(3).write.parquet(src)
    cents = spark.createDataFrame([(0, [0.2, 0.2]), (1, [0.8, 0.8]), (2, [0.2, 0.8])], "centroid_id long, x array<double>")
    out, rows = ST.run_to_table(ST.assign_stream(ST.point_stream(spark, src), cents), str(tmp_path / "out"))
    batch = N.nearest(pts, cents)
    assert out.select("id", "centroid_id").exceptAll(batch.select("id", "centroid_id")).count() == 0
    assert batch.select("id", "centroid_id").exceptAll(out.select("id", "centroid_id")).count() == 0
    assert sum(rows) == 300 and len(rows) >= 3  # progress counters (T5): one file per trigger


def test_text_stream_ingest(spark, tmp_path):
    src = tmp_path / "txt"
    src.mkdir()
    for i in range(3):
        _write(src / f"f{i}.txt", f"w{i} {i}.0 1.0\nbad\n")
    out, rows = ST.run_to_table(ST.vector_stream(spark, str(src)), str(tmp_path / "o"))
    assert sorted(r["label"] for r in out.collect()) == ["w0", "w1", "w2"]


def test_streaming_kmeans_invariants(spark):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.random((600, 2)))],
                                "id long, x array<double>")
    res = C.streaming_kmeans(pts, max_centroids=20, init_size=50, batch_size=100, seed=0)
    cents = res.centroids.collect()
    stats = res.stats.first()
    assert len(cents) == stats["n_centroids"] <= 20
    # counters start at 1 and grow by the rows refined (G-j)
    assert sum(c["n"] for c in cents) == stats["refined_rows"] + len(cents)
    assert stats["min_d2"] > 0 and stats["max_d2"] >= stats["min_d2"]
    if stats["mean_d2"] is not None:
        assert stats["mean_d2"] >= 0


def test_seeding_batch_is_used_up(spark):
    """Every row behind the one that fills the cap refines, whatever the batch size."""
    rng = np.random.default_rng(1)
    x = rng.random((900, 2))
    pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, x array<double>")
    res = C.streaming_kmeans(pts, max_centroids=12, init_size=50, batch_size=10_000, seed=0, order_key=F.col("id"))
    st = res.stats.first()
    accepted = C.accept(N.nearest_to_arrays(pts.where("id >= 50"), list(range(10)), [list(map(float, v)) for v in x[:10]]),
                        shift=st["min_d2"], z=st["max_d2"] - st["min_d2"], seed="0:0", room=2)
    last = accepted.agg(F.max("id")).first()[0]
    assert res.centroids.count() == 12 and st["refined_rows"] == 900 - last - 1 > 0


def test_foreach_batch_kmeans_resumes_to_the_batch_answer(spark, tmp_path):
    """Stopped after two micro-batches and started again (a new handle, state from storage), the
    stream ends with the centroids of the batch run; a replayed batch changes nothing."""
    rng = np.random.default_rng(2)
    n, init, bs = 650, 50, 100
    pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.random((n, 2)))],
                                "id long, x array<double>").persist()
    res = C.streaming_kmeans(pts, max_centroids=15, init_size=init, batch_size=bs, seed=4, order_key=F.col("id"))
    st = res.stats.first()
    src, path = str(tmp_path / "stream"), str(tmp_path / "kmeans")
    initial = [r["x"] for r in pts.where(F.col("id") < 10).orderBy("id").collect()]

    def go_on():
        return ST.streaming_kmeans_stream(ST.point_stream(spark, src, files_per_trigger=100), initial, max_centroids=15,
                                          shift=st["min_d2"], z=st["max_d2"] - st["min_d2"], seed=4, path=path)

    for lo in range(init, n, bs):
        pts.where((F.col("id") >= lo) & (F.col("id") < lo + bs)).write.mode("append").parquet(src)
        state = go_on()  # a run for each batch: the query ends and starts again
    batch = res.centroids.orderBy("centroid_id").collect()
    assert [c[2] for c in state.centroids] == [r["n"] for r in batch]
    assert np.allclose(np.array([c[1] for c in state.centroids]), np.array([r["x"] for r in batch]), atol=1e-9)
    assert np.isclose(state.mean_d2, st["mean_d2"])
    store = ST.StoredCentroids(spark, f"{path}/state", C.CentroidState(15, 0.0, 1.0))
    before = list(store.state.centroids)
    store.update(pts, 3)
    assert store.last == 5 and store.state.centroids == before
