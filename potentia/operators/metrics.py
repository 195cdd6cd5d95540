"""Assignment and centre steps by distance.

Each distance has the centre that its sum (or maximum) asks for: the mean for Euclidean, the
coordinate-wise median for Manhattan, the midrange for Chebyshev, the mean direction for
cosine. Centres are a bounded table (k rows) that is broadcast after a check of its size; medians
are exact: a sketch brackets them and only the values in the bracket are sorted, so a cell of any size is no single
task's work. An assignment that carries ``x`` spares the join back to the points.

Ties go to the smaller centre id. With cosine, zero vectors have no direction and get no centre.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from potentia.operators.neighbors import DEFAULT_MAX_BROADCAST_BYTES, spread
from potentia.operators.ranking import quantile
from potentia.session import cut_lineage, ship_package

_CELLS = 1 << 17
# the sketch's rank is off by a ten-thousandth of a cell's rows at most, a tenth of what the bracket leaves on either side
_BRACKET, _ACCURACY = 0.001, 10_000
DISTANCES = ("euclidean", "manhattan", "chebyshev", "cosine")


def distances(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """All distances of two sets of rows, coordinates taken in index order."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        a, b = q[:, j, None], x[None, :, j]
        if kind == "euclidean":
            out += (a - b) * (a - b)
        elif kind == "manhattan":
            out += np.abs(a - b)
        elif kind == "chebyshev":
            np.maximum(out, np.abs(a - b), out=out)
        else:
            out += a * b
    if kind == "euclidean":
        return np.sqrt(out)
    if kind == "cosine":
        size = np.sqrt(np.square(q).sum(1))[:, None] * np.sqrt(np.square(x).sum(1))[None, :]
        return np.where(size > 0, 1.0 - out / np.where(size > 0, size, 1.0), np.inf)
    return out


def nearest_by(points: DataFrame, centroids: DataFrame, distance: str = "euclidean",
               max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES, with_x: bool = False) -> DataFrame:
    """``id, centroid_id, dist`` of the nearest of ``centroids(centroid_id, x)``; ``with_x``: and the point's ``x``."""
    if distance not in DISTANCES:
        raise ValueError(f"unknown distance {distance!r}")
    spark = points.sparkSession
    ship_package(spark)
    size = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    if size["n"] * (size["d"] or 0) * 8 > max_broadcast_bytes:
        raise ValueError(f"{size['n']} centres of length {size['d']} exceed max_broadcast_bytes")
    t = centroids.select("centroid_id", "x").toArrow().sort_by("centroid_id")
    ids = t["centroid_id"].to_numpy().astype(np.int64)
    mat = np.array(t["x"].to_pylist(), float).reshape(len(ids), size["d"] or 0)
    held = spark.sparkContext.broadcast((ids, mat))

    def run(batches):
        ids, mat = held.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            step = max(1, _CELLS // len(ids))
            for s in range(0, len(x), step):
                d = distances(x[s:s + step], mat, distance)
                best = d.argmin(axis=1)
                dist = d[np.arange(len(d)), best]
                some = np.flatnonzero(np.isfinite(dist))
                at = pa.array(some + s)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array(ids[best[some]]), pa.array(dist[some]),
                                                  *([batch.column("x").take(at)] if with_x else [])],
                                                 ["id", "centroid_id", "dist", *(["x"] if with_x else [])])

    return spread(points.select("id", "x")).mapInArrow(run, "id long, centroid_id long, dist double" + (", x array<double>" if with_x else ""))


def repeated(points: DataFrame) -> DataFrame | None:
    """``id, m`` of the ids that come ``m`` > 1 times, or None: a join by id gives such a point m rows."""
    found = cut_lineage(points.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("m")).where("m > 1"))
    return None if found.isEmpty() else found


def _medians(rows: DataFrame, d: int) -> DataFrame:
    """``centroid_id, x, n``: exact coordinate-wise medians of ``rows(centroid_id, x)``. A sketch brackets each; the second reading
    counts the rows below the bracket and those at each value in it. A median that its bracket misses is ranked in full."""
    rows = rows.select("centroid_id", "x").persist(StorageLevel.MEMORY_AND_DISK)  # read twice
    sketch = cut_lineage(rows.groupBy("centroid_id").agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.percentile_approx(F.col("x")[i], [0.5 - _BRACKET, 0.5 + _BRACKET], _ACCURACY) for i in range(d)]).alias("near")))  # k rows
    value = F.array(*[F.struct(F.lit(i).alias("pos"), F.col("x")[i].alias("v"), F.col("near")[i][0].alias("lo"), F.col("near")[i][1].alias("hi"))
                      for i in range(d)])
    some = (rows.join(F.broadcast(sketch), "centroid_id").select("centroid_id", "n", F.inline(value)).where("v <= hi")
            .groupBy("centroid_id", "n", "pos", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c")))
    upto = F.sum("c").over(Window.partitionBy("centroid_id", "pos").orderBy("v"))  # rows below the bracket come first, as null
    at = F.lit(0.5) * (F.col("n") - 1)

    def ranked(r):
        return F.max(F.when((F.col("_to") - F.col("c") <= r) & (r < F.col("_to")), F.col("v")))

    mid = some.withColumn("_to", upto).groupBy("centroid_id", "pos", "n").agg(ranked(F.floor(at)).alias("_lo"), ranked(F.ceil(at)).alias("_hi"))
    mid = cut_lineage(mid.select("centroid_id", "pos", "n", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - F.floor(at))).alias("q")))
    missed = mid.where("q IS NULL").select("centroid_id").distinct()
    if not missed.isEmpty():
        long = rows.join(F.broadcast(missed), "centroid_id").select("centroid_id", F.posexplode("x").alias("pos", "v"))
        full = quantile(long, "v", 0.5, ["centroid_id", "pos"]).join(sketch.select("centroid_id", "n"), "centroid_id")
        mid = cut_lineage(mid.join(F.broadcast(missed), "centroid_id", "left_anti").unionByName(full.select("centroid_id", "pos", "n", "q")))
    rows.unpersist(blocking=False)
    return (mid.groupBy("centroid_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "q"))).alias("_q"))
            .select("centroid_id", F.transform("_q", lambda c: c["q"]).alias("x"), "n"))


def centres_by(points: DataFrame, assign: DataFrame, distance: str, d: int, repeats: DataFrame | None = None) -> DataFrame:
    """``centroid_id, x, n``: the distance's own centre of each cell that has points. An ``assign`` with ``x`` (and
    ``repeats``, what :func:`repeated` says of the points) gives what the join of both by id gives, without it."""
    if "x" in assign.columns:
        rows = assign.where(F.col("id").isNotNull()).select("id", "centroid_id", "x")
        if repeats is not None:  # a row for each row of the same id
            rows = points.select("id", "x").join(rows.join(repeats, "id").select("id", "centroid_id"), "id").unionByName(
                rows.join(repeats, "id", "left_anti").select("id", "x", "centroid_id"))
    else:
        rows = points.select("id", "x").join(assign.select("id", "centroid_id"), "id")
    n = F.count(F.lit(1)).alias("n")
    if distance == "manhattan":
        return _medians(rows, d)
    if distance == "chebyshev":
        each = [((F.min(F.col("x")[i]) + F.max(F.col("x")[i])) / 2) for i in range(d)]
        return rows.groupBy("centroid_id").agg(F.array(*each).alias("x"), n)
    if distance == "cosine":
        size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
        unit = rows.select("centroid_id", F.transform("x", lambda v: v / size).alias("x"))
        mean = unit.groupBy("centroid_id").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("x"), n)
        return mean.select("centroid_id", F.when(size > 0, F.transform("x", lambda v: v / size)).otherwise(F.col("x")).alias("x"), "n")
    if distance == "euclidean":
        return rows.groupBy("centroid_id").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("x"), n)
    raise ValueError(f"unknown distance {distance!r}")


def lloyd_by(points: DataFrame, seeds: DataFrame, distance: str, d: int, max_iter: int = 20) -> DataFrame:
    """Assignment and centre steps from ``seeds(centroid_id, x)`` until no centre moves or after
    ``max_iter`` rounds; a cell that loses its points is dropped. ``centroid_id, x, n``."""
    cents, before = seeds.select("centroid_id", "x"), None
    for _ in range(max_iter):
        out = cut_lineage(centres_by(points, nearest_by(points, cents, distance), distance, d))
        now = {r["centroid_id"]: tuple(r["x"]) for r in out.collect()}  # k rows
        if now == before:
            break
        cents, before = out.select("centroid_id", "x"), now
    return out
