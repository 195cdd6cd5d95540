"""Connected components of a distributed edge table (alternating large star and small star)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potentia.llm.textio import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)`` (longs); component is the smallest node.

    Each half round is one aggregate with map-side combining and one join on the node, which
    Spark splits where a node is hot. Rounds are written to the checkpoint folder; only a count
    and a checksum of the edges reach the driver. Self loops are dropped, so a node that links
    to nothing else has no row."""

    def star(e: DataFrame) -> DataFrame:
        # every edge points from the larger to the smaller node
        return e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return star(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return star(moved.unionByName(low.select("u", F.col("m").alias("v"))))

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()

    now = stage(star(edges.select("u", "v")), "components")
    seen = mark(now)
    while seen["n"]:
        now = stage(small(large(now)), "components")
        new = mark(now)
        if new == seen:
            break
        seen = new
    # stars now: every edge leads to its component's smallest node
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs (a, b) in the flat parent array ``root`` (root[x] <= x)."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up
