"""Point tables: ``id BIGINT, x ARRAY<DOUBLE>, weight DOUBLE [, label]``.

Builders from the driver tables, weight normalisation, subsets, lookups and filters
(S9, S10, P3, P14, F1-F6, F8-F12, A14).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potentia.functions import rand, vec

# Fixed rescaling of the four numeric lineitem columns into comparable ranges
# (quantity 1-50, price ~1e3-1e5, discount 0-0.1, tax 0-0.08).
LINEITEM_SCALE = (("l_quantity", 0.02), ("l_extendedprice", 0.00001),
                  ("l_discount", 10.0), ("l_tax", 10.0))


def from_embeddings(emb: DataFrame) -> DataFrame:
    """``embeddings(vec_id, embedding FLOAT[], label)`` -> points (float cast to double)."""
    return emb.select(F.col("vec_id").alias("id"),
                      vec.as_double_array("embedding").alias("x"),
                      F.lit(1.0).alias("weight"),
                      F.col("label"))


def lineitem_id() -> Column:
    """Unique BIGINT row key: 60 bits of md5(orderkey:linenumber:partkey:suppkey:qty:cents).

    (orderkey, linenumber) alone repeats in the test tables, and so can the four integer
    keys; adding quantity and the price in integer cents makes every row distinct.
    """
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in
                             ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      F.round(F.col("l_quantity")).cast("long").cast("string"),
                      F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def from_lineitem(li: DataFrame) -> DataFrame:
    """4-D scaled points from lineitem (see :func:`lineitem_id`)."""
    return li.select(lineitem_id().alias("id"),
                     F.array(*[(F.col(c) * F.lit(s)) for c, s in LINEITEM_SCALE]).alias("x"),
                     F.lit(1.0).alias("weight"))


def from_columns(df: DataFrame, id_col: str, cols: list[str], weight: str | None = None) -> DataFrame:
    """Any numeric columns -> vector (S9 / S8 style)."""
    return df.select(F.col(id_col).cast("long").alias("id"),
                     F.array(*[F.col(c).cast("double") for c in cols]).alias("x"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))


def total_weight(points: DataFrame) -> float:
    """Scalar sum of weights; raises on zero total (P3 negative case)."""
    tot = points.agg(F.sum("weight").alias("t")).first()["t"]
    if tot is None or tot == 0:
        raise ValueError("total weight is zero")
    return float(tot)


def normalize_weights(points: DataFrame) -> DataFrame:
    """Weights rescaled to sum 1 (scalar aggregate, then a literal divide)."""
    tot = total_weight(points)
    return points.withColumn("weight", F.col("weight") / F.lit(tot))


def dimension(points: DataFrame) -> int:
    """Dimension from the first row; mixed widths are rejected."""
    row = points.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
    if row["lo"] != row["hi"]:
        raise ValueError(f"mixed vector widths {row['lo']}..{row['hi']}")
    return int(row["lo"])


def subset(points: DataFrame, ids: DataFrame, renormalize: bool = True) -> DataFrame:
    """keep the rows whose id is in ``ids(id)`` (semi join), weights renormalised."""
    sub = points.join(ids.select("id"), "id", "left_semi")
    return normalize_weights(sub) if renormalize else sub


def lookup(points: DataFrame, point_id: int) -> DataFrame:
    """one point by id (pushes down to the scan as an equality filter)."""
    return points.where(F.col("id") == F.lit(point_id))


def in_box(points: DataFrame, lo: list[float], hi: list[float]) -> DataFrame:
    """inclusive box filter."""
    return points.where(vec.in_box("x", lo, hi))


def exclude(points: DataFrame, ignore: DataFrame) -> DataFrame:
    """Anti join on id."""
    return points.join(ignore.select("id"), "id", "left_anti")


def sample_k(points: DataFrame, k: int, seed: int) -> DataFrame:
    """K distinct rows, uniform, reproducible on any partitioning (top-k by hash key)."""
    return (points.withColumn("_u", rand.uniform("id", seed))
            .orderBy("_u", "id").limit(k).drop("_u"))


def weighted_sample(points: DataFrame, k: int, seed: int, weight: str = "weight") -> DataFrame:
    """k rows without replacement, probability proportional to weight
    (exponential-key method: smallest -ln(u)/w); weight <= 0 never drawn."""
    key = -F.log(rand.uniform_open("id", seed)) / F.col(weight)
    return (points.where(F.col(weight) > 0).withColumn("_key", key)
            .orderBy("_key", "id").limit(k).drop("_key"))


def head(points: DataFrame, n: int, order_col: str = "id") -> DataFrame:
    """First n rows by ingestion order."""
    return points.where(F.col(order_col) < F.lit(n)) if order_col == "row_id" else \
        points.orderBy(order_col).limit(n)


def mean_center(points: DataFrame, d: int, by: list[str] | None = None) -> DataFrame:
    """Mean vector (optionally per group), one avg per coordinate (partial aggregation)."""
    by = by or []
    return points.groupBy(*by).agg(
        F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("center"),
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("sum_x"))


def median_center(points: DataFrame, d: int) -> DataFrame:
    """Coordinate-wise exact median (interpolated, as numpy), each from distributed ranks
    (one long column melted from the vectors, ranked per coordinate)."""
    from potentia.operators.ranking import quantile
    melted = points.select(F.posexplode("x").alias("i", "v"))
    med = {r["i"]: r["q"] for r in quantile(melted, "v", 0.5, ["i"]).collect()}  # d rows
    spark = points.sparkSession
    return spark.createDataFrame([([float(med[i]) for i in range(d)],)], "center array<double>")


def drop_furthest(points: DataFrame, n: int, d: int) -> DataFrame:
    """Drop the n points furthest from the mean centre.

    The centre is a d-vector scalar (collected); the n furthest are found by a distributed
    rank on the distance (ties: larger id counts as further), so n may be any size."""
    from potentia.operators.ranking import rank_in_groups
    center = mean_center(points, d).first()["center"]
    c = F.array(*[F.lit(float(v)) for v in center])
    with_d = points.withColumn("_dist", vec.euclidean("x", c))
    ranked = rank_in_groups(with_d, [F.col("_dist").desc(), F.col("id").desc()])
    return ranked.where(F.col("_rank") >= F.lit(n)).drop("_dist", "_rank", "_n")


def beyond_median_distance(points: DataFrame, d: int) -> DataFrame:
    """points whose distance to the coordinate-wise median centre exceeds the median distance."""
    center = median_center(points, d).first()["center"]
    c = F.array(*[F.lit(float(v)) for v in center])
    with_d = points.withColumn("dist", vec.euclidean("x", c))
    from potentia.operators.ranking import quantile_value
    med = quantile_value(with_d, "dist", 0.5)
    return with_d.where(F.col("dist") > F.lit(med))


def rank_column(order: list[Column], partition: list[str] | None = None) -> Column:
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    return F.row_number().over(w)
