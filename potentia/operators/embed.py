"""Two-dimensional embeddings of the voltage (or raw) table and their checks.

Inputs are point tables ``id, x``; for voltage maps use ``voltage.wide`` first.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potentia.operators import neighbors as N
from potentia.operators import points as P
from potentia.operators.blocks import CHECKPOINT_EVERY
from potentia.session import cut_lineage, ship_package

#: Ordered pairs of a part of the pair table, about.
PART_PAIRS = 1 << 20


def pca_2d(points: DataFrame, k: int = 2) -> DataFrame:
    """Centred PCA scores (ML ``PCA`` does not centre the projection, so we do); each
    component's sign is fixed so its largest-magnitude loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = P.dimension(points)
    mean = P.mean_center(points, d).first()["center"]  # d scalars
    m = F.array(*[F.lit(float(v)) for v in mean])
    centred = points.select("id", F.zip_with("x", m, lambda a, b: a - b).alias("x"))
    feats = centred.select("id", array_to_vector("x").alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(feats)
    pcs = model.pc.toArray()  # d x k, driver-sized
    signs = [1.0 if pcs[np.argmax(np.abs(pcs[:, j])), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(feats).select("id", vector_to_array("pc").alias("pc"))
    return out.select("id", F.array(*[F.col("pc")[j] * F.lit(signs[j]) for j in range(k)]).alias("y"))


def stress(layout: DataFrame, points: DataFrame, max_points: int = 20_000) -> DataFrame:
    """Raw stress ``sum_{i<j} (|y_i - y_j| - |x_i - x_j|)^2`` of a layout ``id, y``."""
    dx = N.all_pairs(points.select("id", "x"), max_points=max_points)
    dy = N.all_pairs(layout.select("id", F.col("y").alias("x")), max_points=max_points)
    j = dx.join(dy.withColumnRenamed("d2", "e2"), ["id1", "id2"])
    return j.agg(F.sum(F.pow(F.sqrt("e2") - F.sqrt("d2"), 2)).alias("stress"))


def _pack_pairs(key, pairs: pd.DataFrame, layout: pd.DataFrame) -> pd.DataFrame:
    """A part's points with their first place, and the distances of the pairs that start from them."""
    ids, at = np.unique(pairs["id1"].to_numpy(np.int64), return_inverse=True)
    place = layout.set_index("id")["y"].loc[ids]
    part = {"ids": ids, "at": at, "to": pairs["id2"].to_numpy(np.int64), "delta": pairs["delta"].to_numpy(np.float64),
            "y": np.array(place.to_list(), np.float64).reshape(len(ids), 2)}
    return pd.DataFrame({"part": [key[0]], "packed": [pickle.dumps(part)]})


def _parcels(part: dict, parts: int):
    """Every part needs all places: a bounded number of rows against their pairs."""
    for p in range(parts):
        yield p, (part["ids"], part["y"])


def _guttman(pair: tuple[dict, list], n: int) -> dict:
    """One Guttman transform of a part's points; ``st``: the stress of its pairs before it."""
    part, parcels = pair
    if not len(part["ids"]):
        return part
    ids, y = np.concatenate([p[0] for p in parcels]), np.concatenate([p[1] for p in parcels])
    order = np.argsort(ids, kind="stable")
    other = y[order][np.searchsorted(ids[order], part["to"])]
    diff = part["y"][part["at"]] - other
    dd = np.sqrt(np.square(diff).sum(axis=1))
    ratio = np.divide(part["delta"], dd, out=np.zeros_like(dd), where=dd > 0)
    moved = np.column_stack([np.bincount(part["at"], ratio * diff[:, c], len(part["ids"])) for c in range(2)]) / float(n)
    return {**part, "y": moved, "st": float(np.square(dd - part["delta"]).sum())}


def _places(batches):
    for batch in batches:
        for packed in batch.column("rows"):
            ids, y = pickle.loads(packed.as_py())
            ends = np.arange(len(ids) + 1, dtype=np.int32) * 2
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()))], ["id", "y"])


def mds_2d(points: DataFrame, iters: int = 50, max_points: int = 20_000, eps: float = 1e-9) -> DataFrame:
    """Metric MDS by stress majorisation (SMACOF, Guttman transform), started from
    classical MDS (= centred PCA scores for Euclidean input). The pair table lies in numpy blocks dealt by
    their first point; an iteration is one job without a plan, which sends the layout to the blocks and brings the
    stress of each to the driver; the loop stops when the relative stress change falls below ``eps``. Meant for
    centroid-sized inputs."""
    points = points.persist()  # counted, paired and projected
    spark = points.sparkSession
    ship_package(spark)
    n = points.count()
    parts = max(1, -(-n * n // PART_PAIRS))
    pairs = N.all_pairs(points.select("id", "x"), max_points=max_points)
    ends = F.array(F.struct(F.col("id1"), F.col("id2"), F.sqrt("d2").alias("delta")),
                   F.struct(F.col("id2").alias("id1"), F.col("id1").alias("id2"), F.sqrt("d2").alias("delta")))
    both = pairs.select(F.inline(ends)).withColumn("_part", _part("id1", parts))
    start = pca_2d(points).withColumn("_part", _part("id", parts))
    packed = cut_lineage(both.groupBy("_part").cogroup(start.groupBy("_part")).applyInPandas(_pack_pairs, "part int, packed binary"))
    points.unpersist(blocking=False)
    nothing = {"ids": np.zeros(0, np.int64), "y": np.zeros((0, 2)), "st": 0.0}
    rows = (packed.rdd.map(lambda r: (r["part"], bytes(r["packed"]))).partitionBy(parts, int)
            .mapPartitions(lambda it: iter([next((pickle.loads(p) for _, p in it), nothing)])).persist(StorageLevel.MEMORY_AND_DISK))
    prev = None
    for i in range(1, iters + 1):
        sent = rows.flatMap(partial(_parcels, parts=parts)).partitionBy(parts, int).mapPartitions(lambda it: [[p for _, p in it]])
        old, rows = rows, rows.zip(sent).map(partial(_guttman, n=n)).persist(StorageLevel.MEMORY_AND_DISK)
        if i % CHECKPOINT_EVERY == 0:
            rows.checkpoint()
        st = sum(rows.map(lambda part: part["st"]).collect()) / 2.0
        old.unpersist()
        if prev is not None and prev > 0 and abs(prev - st) / prev < eps:
            break
        prev = st
    out = spark.createDataFrame(rows.map(lambda part: (pickle.dumps((part["ids"], part["y"])),)), "rows binary")
    out = cut_lineage(out.mapInArrow(_places, "id long, y array<double>"))
    rows.unpersist()
    return out


def _part(column: str, parts: int):
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(parts)).cast("int")


def inlier_view(layout: DataFrame, n_outliers: int) -> tuple[DataFrame, DataFrame]:
    """E5: drop the n layout points furthest from the layout centre (F10); return the rest and
    their bounds (min/max per axis)."""
    pts = layout.select("id", F.col("y").alias("x"))
    keep = P.drop_furthest(pts, n_outliers, 2)
    bounds = keep.agg(F.min(F.col("x")[0]).alias("min0"), F.max(F.col("x")[0]).alias("max0"),
                      F.min(F.col("x")[1]).alias("min1"), F.max(F.col("x")[1]).alias("max1"))
    return keep.select("id", F.col("x").alias("y")), bounds
