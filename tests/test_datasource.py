"""Points as a data source: equal to the column generators, for any split, batch or restart."""

import json
import time

import numpy as np
import pytest

from potentia.sources import datasource as D
from potentia.sources import generators as S

CORNERS = [[0.0, 0.0, 1.0], [2.0, 0.5, 0.0], [1.0, 3.0, -1.0]]
CASES = {
    "line": ({"start": -2.0, "end": 3.0}, lambda: S.line(-2.0, 3.0)),
    "square_edge": ({"p1": [0.0, 1.0], "p2": [2.0, 4.0]}, lambda: S.square_edge((0.0, 1.0), (2.0, 4.0))),
    "square_fill": ({"p1": [0.0, 1.0], "p2": [2.0, 4.0]}, lambda: S.square_fill((0.0, 1.0), (2.0, 4.0))),
    "eighth_sphere": ({"radius": 2.0, "y_pos": 0}, lambda: S.eighth_sphere(2.0, 1, 0, 1)),
    "triangle": ({"vertices": CORNERS}, lambda: S.triangle(CORNERS)),
    "clusters": ({"mean": [0.0, 5.0], "external_std": 3.0, "clusters": 4, "internal_std": 0.1, "centers_seed": 6},
                 lambda: S.clusters(S.cluster_centers([0.0, 5.0], 3.0, 4, 6), 0.1)),
    "spiral": ({"radius": 2.0, "rotations": 2, "height": 5.0}, lambda: S.spiral(2.0, 2, 5.0)),
    "grid_1d": ({}, lambda: S.grid_1d(500)),
}


def source(reader, shape, rows, **options):
    reader = reader.format(D.NAME).option("shape", shape).option("rows", rows).option("seed", "9")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def points(df):
    rows = df.collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: (list(r["x"]), r["weight"]) for r in rows}


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    D.register(spark)


@pytest.mark.parametrize("shape", sorted(CASES))
def test_equals_the_column_expression(spark, shape):
    params, gen = CASES[shape]
    got = points(source(spark.read, shape, 500, params=json.dumps(params), partitions=3))
    want = points(S.over(spark.range(500), gen(), 9))
    assert got.keys() == want.keys()
    assert np.allclose([got[i][0] for i in range(500)], [want[i][0] for i in range(500)], rtol=0, atol=1e-12)
    assert all(w == 1.0 for _, w in got.values())


def test_any_split_gives_the_same_rows(spark):
    one = source(spark.read, "spiral", 20_000, partitions=1)
    many = source(spark.read, "spiral", 20_000, partitions=7)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 7
    assert points(one) == points(many)
    assert source(spark.read, "line", 0).count() == 0 and points(source(spark.read, "line", 2, partitions=9)).keys() == {0, 1}


def test_bounds_on_id_narrow_the_read(spark):
    df = source(spark.read, "line", 10**12, partitions=2)
    assert sorted(points(df.where("id >= 999999999990 and id < 999999999993"))) == [999999999990, 999999999991, 999999999992]
    assert sorted(points(df.where("id = 5 and weight > 0"))) == [5]
    assert points(df.where("id < 0")) == {} and points(df.where("id = 5 and id = 6")) == {}
    assert sorted(points(df.where("id > 999999999998 or id = -1").where("id > 999999999997"))) == [999999999999]


def test_unknown_shape_and_negative_rows(spark):
    with pytest.raises(Exception, match="unknown shape"):
        source(spark.read, "cube", 10).count()
    with pytest.raises(Exception, match="negative"):
        source(spark.read, "line", -1).count()


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    """A query that is stopped half-way goes on behind its last batch."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    rows = 400

    def run(since):
        q = (source(spark.readStream, "square_fill", rows, rowsPerSecond=10, since=since, partitions=2).writeStream
             .format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start())
        q.awaitTermination(60)
        assert q.exception() is None
        q.stop()
        return spark.read.schema("id long, x array<double>, weight double").parquet(out)

    now = time.time()
    half = run(now - 20).count()  # 200 rows and those of the seconds the start takes
    assert 200 <= half < rows
    assert points(run(now - 100)) == points(source(spark.read, "square_fill", rows))
    assert run(now - 100).count() == rows


def test_stream_of_all_rows(spark, tmp_path):
    q = (source(spark.readStream, "line", 3000, partitions=3).writeStream.format("memory").queryName("potentia_all")
         .option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start())
    q.awaitTermination(60)
    assert points(spark.table("potentia_all")) == points(source(spark.read, "line", 3000))
