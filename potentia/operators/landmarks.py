"""Landmark selection (L1-L7): every builder returns ``problem_id, id, voltage``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from potentia.functions import vec
from potentia.operators import neighbors, points as P


def explicit(spark, rows: list[tuple[int, int, float]]) -> DataFrame:
    """L1: landmarks given as (problem_id, id, voltage) rows."""
    return spark.createDataFrame(rows, "problem_id int, id long, voltage double")


def add(landmarks: DataFrame, more: DataFrame) -> DataFrame:
    """L1 addLandmarks: union; a node that ``more`` names again in a problem takes its new voltage (the
    highest, should ``more`` itself name it twice)."""
    cols = landmarks.columns
    new = more.groupBy("problem_id", "id").agg(*[F.max(c).alias(c) for c in cols if c not in ("problem_id", "id")])
    return landmarks.join(new.select("problem_id", "id"), ["problem_id", "id"], "left_anti").select(*cols).unionByName(new.select(*cols))


def closest_to(pts: DataFrame, target: list[float], problem_id: int = 0, voltage: float = 1.0,
               ignore: DataFrame | None = None, dist=vec.sq_dist) -> DataFrame:
    """L2: the point closest to a coordinate (ignore list honoured for all ids, D17)."""
    c = neighbors.closest_to(pts, target, dist=dist, ignore=ignore)
    return c.select(F.lit(problem_id).alias("problem_id"), "id", F.lit(float(voltage)).alias("voltage"))


def in_box(pts: DataFrame, lo: list[float], hi: list[float], problem_id: int = 0,
           voltage: float = 1.0) -> DataFrame:
    """L3: every point inside an inclusive box."""
    return P.in_box(pts, lo, hi).select(F.lit(problem_id).alias("problem_id"), "id",
                                        F.lit(float(voltage)).alias("voltage"))


def first_per_label(pts: DataFrame, voltage: float = 1.0) -> DataFrame:
    """L4: the smallest id of every label; one problem per label (problem_id = label rank)."""
    firsts = pts.groupBy("label").agg(F.min("id").alias("id"))
    w = Window.orderBy("label")  # one row per label: tiny
    return firsts.select((F.row_number().over(w) - 1).cast("int").alias("problem_id"), "id",
                         F.lit(float(voltage)).alias("voltage"), "label")


def closest_to_class_mean(pts: DataFrame, d: int, voltage: float = 1.0) -> DataFrame:
    """Per label, the member closest to the label's mean vector (no retry loop needed)."""
    means = P.mean_center(pts, d, by=["label"]).select("label", "center")
    j = pts.join(F.broadcast(means), "label")  # one row per label
    best = j.groupBy("label").agg(F.min_by("id", F.struct(vec.sq_dist("x", "center"), F.col("id"))).alias("id"))
    w = Window.orderBy("label")
    return best.select((F.row_number().over(w) - 1).cast("int").alias("problem_id"), "id",
                       F.lit(float(voltage)).alias("voltage"), "label")


def random_k(pts: DataFrame, k: int, seed: int, voltage: float = 1.0) -> DataFrame:
    """K distinct random points (D12: only existing ids), one problem each."""
    s = P.sample_k(pts.select("id"), k, seed)
    w = Window.orderBy("id")
    return s.select((F.row_number().over(w) - 1).cast("int").alias("problem_id"), "id",
                    F.lit(float(voltage)).alias("voltage"))


def by_key(pts: DataFrame, keys: list, key_col: str = "label", voltage: float = 1.0) -> DataFrame:
    """Landmark by key (word -> row), smallest id per key, in the order given."""
    spark = pts.sparkSession
    kdf = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"problem_id int, {key_col} string")
    hit = pts.select(F.col(key_col).cast("string").alias(key_col), "id").groupBy(key_col).agg(F.min("id").alias("id"))
    return kdf.join(hit, key_col).select("problem_id", "id", F.lit(float(voltage)).alias("voltage"))
