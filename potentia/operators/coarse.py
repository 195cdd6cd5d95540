"""Coarse space of the two-level preconditioner of the exact solver (V1, V3).

Plain conjugate gradient moves current one hop a round, so its rounds grow with the graph's diameter.
The second level carries it over whole cells at once: with ``Z`` the 0/1 table of node and cell, the
residual's cell sums are solved against ``E = Z' A Z`` and each node gets its cell's correction,

    u = r / diag + Z E^-1 Z' r .

``E`` has one row a cell. It is summed on Spark and held, a problem at a time, on the driver, where ``cells^2 x problems``
doubles stay below ``max_bytes``: beyond that, cells are merged by hash, which makes the
correction coarser and leaves the solution as it is. Cells may be anything (the compressor's cells,
V5's, :func:`around`); a node without a cell gets the first term only.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potentia.operators import neighbors
from potentia.operators import points as P

#: Bytes of coarse matrices held on the driver.
MAX_BYTES = 32 << 20


def around(points: DataFrame, k: int = 256, seed: int = 0) -> DataFrame:
    """``id, centroid_id``: the nearest of ``k`` points drawn at random (one J1 pass)."""
    centres = P.sample_k(points.select("id", "x"), k, seed).select(F.col("id").alias("centroid_id"), "x")
    return neighbors.nearest(points, centres).select("id", "centroid_id")


class CoarseSpace:
    """``cells(id, centroid_id)`` over ``graph`` for the problems ``pids``, whose landmarks
    ``fixed(problem_id, id)`` are no unknowns. ``numbered(id, _z)`` are the cells in use."""

    def __init__(self, graph, fixed: DataFrame, cells: DataFrame, pids: list, max_bytes: int = MAX_BYTES):
        self.spark = graph.edges.sparkSession
        self.place = {p: i for i, p in enumerate(pids)}
        room = max(1, math.isqrt(max_bytes // (8 * max(1, len(pids)))))
        one = cells.where(F.col("centroid_id").isNotNull()).groupBy("id").agg(F.min("centroid_id").alias("centroid_id")).persist()
        names = [r[0] for r in one.select("centroid_id").distinct().orderBy("centroid_id").limit(room + 1).collect()]
        if len(names) <= room:
            self.k = len(names)
            table = self.spark.createDataFrame([(c, i) for i, c in enumerate(names)],
                                               f"centroid_id {one.schema['centroid_id'].dataType.simpleString()}, _z int")
            self.numbered = one.join(F.broadcast(table), "centroid_id").select("id", "_z")
        else:
            self.k = room
            self.numbered = one.select("id", F.pmod(F.xxhash64("centroid_id"), F.lit(room)).cast("int").alias("_z"))
        self.numbered = self.numbered.persist()
        self._held = (self.numbered, one)
        try:
            self.inverse = self._inverses(graph, fixed.select("problem_id", "id")) if self.k else {}
        except BaseException:
            self.release()
            raise

    def _inverses(self, graph, fixed: DataFrame) -> dict:
        own = ["problem_id"] if "problem_id" in graph.nodes.columns else []
        z = self.numbered
        edges = (graph.edges.select(*own, "src", "dst", "w")
                 .join(z.select(F.col("id").alias("src"), F.col("_z").alias("a")), "src")
                 .join(z.select(F.col("id").alias("dst"), F.col("_z").alias("b")), "dst"))
        nodes = graph.nodes.select(*own, "id", (F.col("deg") + F.col("g")).alias("w")).join(z, "id").withColumnRenamed("_z", "a")
        # parts of E: sums over cells and pairs of cells, at most k^2 rows a problem
        whole = (edges.groupBy(*own, "a", "b").agg((-F.sum("w")).alias("w"))
                 .unionByName(nodes.groupBy(*own, "a").agg(F.sum("w").alias("w")).withColumn("b", F.col("a"))).collect())
        # rows and columns of the landmarks leave E: edges from a landmark count for both directions,
        # those between two landmarks come from both ends
        source = edges.join(fixed.withColumnRenamed("id", "src"), [*own, "src"])
        target = fixed.select("problem_id", F.col("id").alias("dst"), F.lit(True).alias("_both"))
        held = source.join(target, ["problem_id", "dst"], "left").groupBy("problem_id", "a", "b").agg(
            F.sum("w").alias("w"), F.sum(F.when(F.col("_both"), F.col("w")).otherwise(F.lit(0.0))).alias("both")).collect()
        gone = nodes.join(fixed, [*own, "id"]).groupBy("problem_id", "a").agg(F.sum("w").alias("w")).collect()
        zero = np.zeros((self.k, self.k))
        common = zero.copy()
        parts: dict = {}
        for r in whole:
            (parts.setdefault(r["problem_id"], zero.copy()) if own else common)[r["a"], r["b"]] += r["w"]
        matrices = {p: parts.get(p, zero).copy() if own else common.copy() for p in self.place}
        for r in held:
            if r["problem_id"] in matrices:
                m = matrices[r["problem_id"]]
                m[r["a"], r["b"]] += r["w"] - r["both"]
                m[r["b"], r["a"]] += r["w"]
        for r in gone:
            if r["problem_id"] in matrices:
                matrices[r["problem_id"]][r["a"], r["a"]] -= r["w"]
        return {p: _inverse(m) for p, m in matrices.items()}

    def corrections(self, sums: np.ndarray) -> np.ndarray:
        """The cells' corrections for the residual sums, a row a problem."""
        return np.stack([self.inverse[p] @ sums[i] for p, i in self.place.items()])

    def release(self) -> None:
        for df in self._held:
            df.unpersist(blocking=False)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse on the space where the matrix is positive: cells without current (all of them
    landmarks, or no way to a ground) are left to the first level."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    used = values > 1e-12 * max(values[-1], 0.0) if len(values) else values > 0
    return (vectors[:, used] / values[used]) @ vectors[:, used].T
