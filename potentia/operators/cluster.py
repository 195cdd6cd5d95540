"""Clustering and compression.

Centroid tables are ``centroid_id BIGINT, x ARRAY<DOUBLE>, n BIGINT``. Every pass over the
points is a distributed job (broadcast-index assignment + partial aggregation); only the
centroid state - bounded by the caller's ``k`` / ``max_centroids`` - ever reaches the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from potentia.functions import rand, vec
from potentia.operators import neighbors as N
from potentia.operators.staged import StagedPoints, add_up, draw
from potentia.session import checkpoint_dir, cut_lineage


# ----------------------------------------------------------------------------- per-cell stats
def cell_counts(assign: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """A1: points per cell; with ``centroids`` empty cells are kept with 0."""
    c = assign.groupBy("centroid_id").agg(F.count(F.lit(1)).alias("n"))
    if centroids is None:
        return c
    return (centroids.select("centroid_id").join(c, "centroid_id", "left")
            .select("centroid_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def cell_sums(points: DataFrame, assign: DataFrame, d: int) -> DataFrame:
    """Per cell: count, coordinate sums, sum of d2 (partial aggregation, map-side combine)."""
    j = points.select("id", "x").join(assign, "id")
    return j.groupBy("centroid_id").agg(
        F.count(F.lit(1)).alias("m"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("sx"),
        F.sum("d2").alias("sd2"))


def cell_means(points: DataFrame, assign: DataFrame, d: int) -> DataFrame:
    """Mean vector per non-empty cell."""
    s = cell_sums(points, assign, d)
    return s.select("centroid_id", F.transform("sx", lambda v: v / F.col("m")).alias("x"),
                    F.col("m").cast("long").alias("n"))


def _centroid_arrays(centroids: DataFrame):
    rows = centroids.select("centroid_id", "x").collect()  # bounded by the caller's k
    return [r["centroid_id"] for r in rows], [list(r["x"]) for r in rows]


def assign_average(points: DataFrame, centroids: DataFrame, d: int) -> DataFrame:
    """One assign + average pass from given seeds (empty cells dropped). Assignment and
    per-cell sums happen in one kernel pass (map-side combine), no join back on id."""
    ids, mat = _centroid_arrays(centroids)
    s = N.assign_and_sum(points, ids, mat)
    return s.select("centroid_id", F.transform("sx", lambda v: v / F.col("m")).alias("x"),
                    F.col("m").cast("long").alias("n"))


def top_per_cell(assign: DataFrame, n: int = 5) -> DataFrame:
    """The n closest members of every cell (window top-k, pruned before the shuffle)."""
    w = Window.partitionBy("centroid_id").orderBy("d2", "id")
    return assign.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ----------------------------------------------------------------------------- seeding
def accept(d: DataFrame, *, shift: float, z: float, seed, room: int | None, order: str = "id") -> DataFrame:
    """keep rows with ``u < clip((d2-shift)/z, 0, 1)`` and ``d2 > 0``, at most ``room``
    of them in stream order."""
    p = vec.accept_probability("d2", shift, z)
    a = d.where((rand.uniform("id", seed) < p) & (F.col("d2") > 0))
    return a.orderBy(order).limit(room) if room is not None else a


def kmeans_pp(points: DataFrame, k: int, seed: int, distance: str = "euclidean") -> DataFrame:
    """K-means++ seeding where the next centre is drawn with probability proportional
    to the *distance* (not squared) to the nearest chosen centre (weighted draw F9); X1: ``distance``
    names one of the library's distances.

    Each pick is one distributed pass; the running minimum distance is carried as a column
    and the table is checkpointed every few picks.
    """
    dist = vec.distance(distance)
    pts = cut_lineage(points.select("id", "x"))  # read once a pick
    first = pts.withColumn("_k", -F.log(rand.uniform_open("id", f"{seed}:0"))).orderBy("_k", "id").first()
    chosen = [(0, int(first["id"]), list(first["x"]))]
    cur = pts.withColumn("min_d", dist("x", F.array(*[F.lit(float(v)) for v in first["x"]])))
    for i in range(1, k):
        if i % 5 == 0:
            cur = cut_lineage(cur)
        key = -F.log(rand.uniform_open("id", f"{seed}:{i}")) / F.col("min_d")
        nxt = cur.where(F.col("min_d") > 0).withColumn("_k", key).orderBy("_k", "id").first()
        if nxt is None:
            break
        chosen.append((i, int(nxt["id"]), list(nxt["x"])))
        c = F.array(*[F.lit(float(v)) for v in nxt["x"]])
        cur = cur.withColumn("min_d", F.least("min_d", dist("x", c)))
    spark = points.sparkSession
    return spark.createDataFrame(chosen, "centroid_id long, id long, x array<double>")


def lloyd(points: DataFrame, k: int, seed: int, max_iter: int = 20, weight: str | None = "weight") -> DataFrame:
    """Lloyd k-means with k-means|| start via ``pyspark.ml`` (weights honoured)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    df = points.select("id", array_to_vector("x").alias("features"),
                       *([F.col(weight).alias("w")] if weight and weight in points.columns else []))
    km = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="centroid_id")
    if weight and weight in points.columns:
        km = km.setWeightCol("w")
    model = km.fit(df)
    pred = model.transform(df).groupBy("centroid_id").agg(F.count(F.lit(1)).alias("n"))
    spark = points.sparkSession
    cents = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())],
                                  "centroid_id int, x array<double>")
    return cents.join(pred, "centroid_id", "left").select(F.col("centroid_id").cast("long"), "x",
                                                          F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class_centroids(points: DataFrame, per_class: int, seed: int, d: int, iters: int = 1) -> DataFrame:
    """``per_class`` centroids for every label in one job, class-major ids.

    Seeds = the first ``per_class`` rows of each label by hash order; ``iters`` assign+average
    passes where a point may only join centroids of its own label.
    """
    w = Window.partitionBy("label").orderBy("_u", "id")
    seeds = (points.withColumn("_u", rand.uniform("id", seed)).withColumn("_r", F.row_number().over(w))
             .where(F.col("_r") <= per_class))
    cents = seeds.select("label", (F.col("label").cast("long") * per_class + F.col("_r") - 1).alias("centroid_id"),
                         "x")
    for _ in range(iters):
        asg = N.knn(points.select("id", "x", "label").withColumnRenamed("label", "group"),
                    cents.select(F.col("centroid_id").alias("id"), "x", F.col("label").alias("group")), 1,
                    group=True)
        asg = asg.select(F.col("src").alias("id"), F.col("dst").alias("centroid_id"), "d2")
        means = cell_means(points, asg, d)
        cents = means.join(cents.select("centroid_id", "label"), "centroid_id")
    return cents


# ----------------------------------------------------------------------------- streaming k-means
def with_row_ids(df: DataFrame, order_key, parts: int | None = None) -> DataFrame:
    """Dense ``row_id`` 0..n-1 in ``order_key`` order without a single-partition window:
    range-partition + sort; the position inside each partition comes from
    ``monotonically_increasing_id`` (record number in the low 33 bits), the per-partition
    counts (one small action) give the offsets - no second shuffle."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pid = F.spark_partition_id().cast("long")
    s = (df.withColumn("_key", order_key).repartitionByRange(parts, "_key", "id")
         .sortWithinPartitions("_key", "id")
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(pid, 33)))
    s = cut_lineage(s)  # the counts and the numbering must see the same partitions
    counts = sorted((r["_pid"], r["c"]) for r in s.groupBy("_pid").agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, acc = {}, 0
    for p_, c in counts:
        offsets[p_] = acc
        acc += c
    off = F.create_map(*[x for p_, o in offsets.items() for x in (F.lit(p_), F.lit(o))]) if offsets else F.lit(None)
    return s.withColumn("row_id", (off[F.col("_pid")] + F.col("_pos")).cast("long")).drop("_pid", "_key", "_pos")


@dataclass
class Compressed:
    centroids: DataFrame      # centroid_id, x, n
    stats: DataFrame          # one row: max_d2, min_d2, seeded, initial_mean_d2, mean_d2, refined_rows


@dataclass
class CentroidState:
    """What seeding and refinement carry from batch to batch: at most ``max_centroids`` rows and a few
    numbers, on the driver."""
    max_centroids: int
    shift: float | None
    z: float | None
    seed: int = 0
    centroids: list = field(default_factory=list)   # (centroid_id, x, n)
    total_d2: float = 0.0
    total_n: int = 0
    initial_mean_d2: float | None = None
    mean_d2: float | None = None

    def take(self, batch: DataFrame, number: int, order: str) -> None:
        """One batch of ``(id, x, order)`` rows: below the cap it seeds (C6, T2); the rows after the one
        that fills the cap, and every later batch, refine (C7, T3)."""
        if not self.centroids:
            return
        if len(self.centroids) < self.max_centroids:
            if not self.z:
                return
            d = N.nearest_to_arrays(batch, [c[0] for c in self.centroids], [c[1] for c in self.centroids],
                                    carry=tuple(dict.fromkeys(("x", order))) if order != "id" else ("x",))
            room = self.max_centroids - len(self.centroids)
            got = accept(d, shift=self.shift, z=self.z, seed=f"{self.seed}:{number}", room=room, order=order)
            rows = got.select("x", order).orderBy(order).collect()  # at most ``room`` rows
            self.centroids += [(len(self.centroids) + i, list(r["x"]), 1) for i, r in enumerate(rows)]
            if len(self.centroids) < self.max_centroids:
                return
            batch = batch.where(F.col(order) > F.lit(rows[-1][order]))
        self._refine(batch)

    def take_staged(self, staged: StagedPoints, lo: int, hi: int, number: int, by_id: bool = False) -> None:
        """:meth:`take` for the rows ``lo..hi-1`` of a staged stream, in their order: one job, or two where the cap is met.
        ``by_id``: the order is that of ids, and rows with the id of the one that fills the cap do not refine."""
        if not self.centroids:
            return
        if len(self.centroids) < self.max_centroids:
            if not self.z:
                return
            room = self.max_centroids - len(self.centroids)
            pick = partial(draw, mat=np.array([c[1] for c in self.centroids], float), shift=self.shift, z=self.z,
                           seed=f"{self.seed}:{number}", room=room)
            rows = [row for piece in staged.run(lo, hi, pick) for row in piece][:room]
            self.centroids += [(len(self.centroids) + i, x, 1) for i, (_, x) in enumerate(rows)]
            if len(self.centroids) < self.max_centroids:
                return
            lo = rows[-1][0] + 1
            if by_id:
                last = staged.run(lo - 1, lo, lambda ids, named, x, row_ids: int(ids[0]))[0]
                lo += sum(staged.run(lo, hi, lambda ids, named, x, row_ids: int(((ids == last) & named).sum())))
        mat = np.array([c[1] for c in self.centroids], float)
        m, sx, sd2 = add_up(staged.run(lo, hi, lambda ids, named, x, row_ids: N.assign_sums(x, mat)), *mat.shape)
        self._move({self.centroids[i][0]: {"m": int(m[i]), "sx": sx[i].tolist(), "sd2": sd2[i]} for i in np.flatnonzero(m)})

    def _refine(self, batch: DataFrame) -> None:
        part = N.assign_and_sum(batch, [c[0] for c in self.centroids], [c[1] for c in self.centroids])
        self._move({r["centroid_id"]: r for r in part.collect()})  # <= max_centroids rows

    def _move(self, sums: dict) -> None:
        new = []
        for cid, x, n in self.centroids:
            s = sums.get(cid)
            if s is None:
                new.append((cid, x, n))
                continue
            m = int(s["m"])
            new.append((cid, [(xi * n + si) / (n + m) for xi, si in zip(x, s["sx"])], n + m))
            self.total_d2 += float(s["sd2"])
            self.total_n += m
        self.centroids = new
        if self.total_n:
            self.mean_d2 = self.total_d2 / self.total_n
            if self.initial_mean_d2 is None:
                self.initial_mean_d2 = self.mean_d2

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c[0], [float(v) for v in c[1]], int(c[2])) for c in self.centroids],
                                     "centroid_id long, x array<double>, n long")


#: Rows a batch of a stream, at any size of the stream: part of the result, as in any mini-batch method.
BATCH_ROWS = 10_000


def streaming_kmeans(points: DataFrame, *, max_centroids: int = 1000, init_size: int = 1000,
                     batch_size: int = BATCH_ROWS, seed: int = 0, seed_rows: int = 10,
                     normalize: bool = False, order_key=None) -> Compressed:
    """C5 -> C6 -> C7 (C8): one forward pass over a stream of points in three phases.

    Rows are numbered in stream order (``order_key``, default a hash permutation of id, W5).
    Phase 1: the first ``init_size`` rows give the distance scale (min/max pairwise d2, C5)
    and the first ``seed_rows`` of them the initial centroids. Phase 2: following batches
    add rows with probability ``clip((d2-min)/(max-min))`` (F7) until ``max_centroids``.
    Phase 3: the rest of the batch that filled the cap and all further batches refine centroids by
    running weighted means (counters start at 1) and track the mean squared distance (A3, A4, A17).

    The stream is staged once in its order (:class:`StagedPoints`), so every batch is a job on its own rows;
    the centroid state (at most ``max_centroids`` rows) is the only driver state.
    """
    for name, val in (("max_centroids", max_centroids), ("init_size", init_size), ("batch_size", batch_size)):
        if val <= 0:
            raise ValueError(f"{name} must be a positive integer")
    spark = points.sparkSession
    pts = points.select("id", vec.l2_normalize("x").alias("x") if normalize else "x")
    key = order_key if order_key is not None else rand.uniform("id", f"stream:{seed}")
    staged = StagedPoints(pts, key)

    buf = staged.rows(0, init_size).persist()
    mm = N.pairwise_min_max(buf, max_points=max(init_size, 1)).first()
    max_d2, min_d2 = mm["max_d2"], mm["min_d2"]
    z = (max_d2 - min_d2) if (max_d2 is not None and min_d2 is not None) else None
    state = CentroidState(max_centroids, min_d2, z, seed,
                          [(i, list(r["x"]), 1) for i, r in enumerate(buf.orderBy("row_id").limit(seed_rows).collect())])
    buf.unpersist()
    for b, lo in enumerate(range(init_size, staged.n, batch_size)):
        state.take_staged(staged, lo, min(lo + batch_size, staged.n), b)
    sdf = spark.createDataFrame([(max_d2, min_d2, len(state.centroids), state.initial_mean_d2, state.mean_d2, state.total_n)],
                                "max_d2 double, min_d2 double, n_centroids long, initial_mean_d2 double, "
                                "mean_d2 double, refined_rows long")
    return Compressed(state.frame(spark), sdf)


def refine(points: DataFrame, centroids: DataFrame, d: int) -> DataFrame:
    """C7 for one batch as a pure DataFrame step (A3): ``x' = (x n + sum) / (n + m)``, ``n' = n + m``.
    Used by the streaming sink; associative, so partial aggregation does the heavy lifting."""
    ids, mat = _centroid_arrays(centroids)
    s = N.assign_and_sum(points, ids, mat)
    j = centroids.join(s, "centroid_id", "left")
    m = F.coalesce("m", F.lit(0))
    x = F.when(F.col("m").isNull(), F.col("x")).otherwise(
        F.zip_with("x", "sx", lambda a, b: (a * F.col("n") + b) / (F.col("n") + F.col("m"))))
    return j.select("centroid_id", x.alias("x"), (F.col("n") + m).alias("n"),
                    F.coalesce("sd2", F.lit(0.0)).alias("batch_d2"), m.cast("long").alias("batch_n"))


def intrinsic_dimension(points: DataFrame, d: int, ks: list[int], seed: int) -> DataFrame:
    """C11: for each k, one assign+average pass from k hash-sampled seeds, then the mean
    distance to the assigned centre; dimension = -1 / slope(log dist ~ log k) (A15)."""
    from potentia.operators.points import sample_k
    rows = []
    points = cut_lineage(points.select("id", "x"))  # read twice for each k
    # the smaller samples are the first rows of the largest
    drawn = sample_k(points, max(ks), seed).collect()
    spark = points.sparkSession
    for k in ks:
        cents = spark.createDataFrame([(r["id"], r["x"]) for r in drawn[:k]], "centroid_id long, x array<double>")
        means = assign_average(points, cents, d)
        asg = N.nearest(points, means.select("centroid_id", "x"))
        rows.append(asg.agg(F.avg(F.sqrt("d2")).alias("dist")).select(F.lit(k).alias("k"), "dist"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.agg((F.lit(-1.0) / F.regr_slope(F.log("dist"), F.log("k"))).alias("dimension"))


# ----------------------------------------------------------------------------- mean shift
def mean_shift(points: DataFrame, bandwidth: float | list[float], *, max_iter: int = 50, tol: float = 1e-6, **index) -> DataFrame:
    """Flat-kernel mean shift. Every point starts a mode; each step moves a mode to the
    mean of the points within ``bandwidth`` (a radius search on the metric index, whose sums are
    folded where the points lie), until no mode moves more than ``tol``. Converged modes closer than
    the bandwidth merge, the one with more points in reach kept (ties: lower id).

    Several bandwidths are problems of the same jobs. Merging is the greedy choice by (n, id) in
    rounds: a mode stays when it is the densest undecided one within its reach, and takes away those
    it reaches. Neither points nor modes are collected and their number is not limited; ``index``
    goes to :class:`RadiusIndex`. A mode that has not come to rest after ``max_iter`` steps is taken as
    it is. Returns ``problem_id, mode_id, x, n`` (n = points within bandwidth of the mode, mode ids in
    order of density), without ``problem_id`` for a single bandwidth."""
    from potentia.operators import radius as R
    from potentia.operators.ranking import rank_in_groups
    several = not isinstance(bandwidth, (int, float))
    widths = [float(b) for b in (bandwidth if several else [bandwidth])]
    base = cut_lineage(points.select("id", "x"))
    found = R.RadiusIndex(base, **index)
    # a mode is named by its problem and its place among the points: one long
    numbered = rank_in_groups(base, ["id"]).select(F.col("_rank").alias("no"), "x")
    problem = F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in range(len(widths))]).alias("p"), F.array(*[F.lit(b) for b in widths]).alias("r")))
    modes = cut_lineage(numbered.select("no", "x", problem.alias("_p"))
                        .select((F.col("_p.p").cast("long") * found.n + F.col("no")).alias("id"), "x", F.col("_p.r").alias("r")))
    resting = None  # modes that moved no more than rounding: the points stand still, so they stay
    for _ in range(max_iter):
        near = R.radius_sums(found, modes)
        step = cut_lineage(modes.join(near, "id").select(
            "id", F.transform("sx", lambda v: v / F.col("n")).alias("x"), "r", vec.sq_dist(F.transform("sx", lambda v: v / F.col("n")), F.col("x")).alias("moved")))
        far = step.agg(F.max("moved").alias("m"), F.count_if(F.col("moved") > (tol * 1e-6) ** 2).alias("left")).first()
        rest = step.where(F.col("moved") <= (tol * 1e-6) ** 2).select("id", "x", "r")
        resting = rest if resting is None else resting.unionByName(rest)
        modes = step.where(F.col("moved") > (tol * 1e-6) ** 2).select("id", "x", "r")
        if far["m"] is None or far["m"] <= tol * tol:
            break
    modes = cut_lineage(modes if resting is None else resting.unionByName(modes))
    counted = cut_lineage(modes.join(R.radius_sums(found, modes).select("id", F.col("n").alias("rank")), "id"))
    # problems side by side in one more coordinate, farther apart than any reach
    gap = 4.0 * max(widths)
    place = F.floor(F.col("id") / F.lit(max(found.n, 1)))
    undecided = counted.withColumn("x", F.concat("x", F.array(place * F.lit(gap))))
    kept = None
    while not undecided.isEmpty():
        there = R.RadiusIndex(undecided, carry=("rank",), **index)
        best = R.best_in_reach(there, undecided).where("first = id").select("id")
        chosen = cut_lineage(undecided.join(best, "id", "left_semi"))
        # gone: the modes that a chosen one reaches, itself included
        reached = there.search(chosen, R.Pairs()).select(F.col("dst").alias("id")).distinct()
        undecided = cut_lineage(undecided.join(reached, "id", "left_anti"))
        kept = chosen if kept is None else kept.unionByName(chosen)
    if kept is None:
        kept = undecided
    kept = kept.select(place.alias("problem_id"), "id", F.slice("x", 1, max(found.dim, 1)).alias("x"), F.col("rank").alias("n"))
    out = rank_in_groups(kept, [F.desc("n"), F.col("id")], ["problem_id"])
    cols = [F.col("_rank").alias("mode_id"), "x", "n"]
    return out.select(*(["problem_id"] if several else []), *cols)


def mean_shift_for_count(points: DataFrame, target: int, *, lo: float = 0.01, hi: float = 10.0,
                         max_tries: int = 20, ahead: int = 3, exact: bool = True, **index) -> tuple[float, DataFrame]:
    """Bisect the bandwidth (geometric) until the number of modes equals ``target``; if no try meets it, an
    error names the nearest count, or without ``exact`` that try is the result. The next ``ahead`` levels of the bisection are problems of
    one mean shift, whose answers the search then follows: the same tries as one by one."""
    import math
    counts: dict[float, int] = {}
    while len(counts) < max_tries:
        spans, level = [], [(lo, hi)]
        for _ in range(min(ahead, max_tries - len(counts))):
            spans += level
            level = [s for a, b in level for s in ((a, math.sqrt(a * b)), (math.sqrt(a * b), b))]
        widths = [math.sqrt(a * b) for a, b in spans]
        modes = cut_lineage(mean_shift(points, widths, **index))
        got = {r["problem_id"]: r["count"] for r in modes.groupBy("problem_id").count().collect()}
        at = 0
        while at < len(widths):
            k = counts[widths[at]] = got.get(at, 0)
            if k == target:
                return widths[at], modes.where(F.col("problem_id") == at).drop("problem_id")
            lo, hi = (widths[at], spans[at][1]) if k > target else (spans[at][0], widths[at])
            at = 2 * at + (2 if k > target else 1)
    nearest = min(counts.items(), key=lambda c: abs(c[1] - target))
    if not exact:
        return nearest[0], mean_shift(points, nearest[0], **index)
    raise ValueError(f"no bandwidth gave {target} modes in {max_tries} tries; {nearest[0]:.6g} gave {nearest[1]}")


# ----------------------------------------------------------------------------- spectral
def spectral(edges: DataFrame, nodes: DataFrame, k: int = 10, **kw) -> DataFrame:
    """K-means on the Laplacian's eigenvectors after the first, ``id, cluster`` (see ``operators.spectral``)."""
    from potentia.operators.spectral import spectral_clusters
    return spectral_clusters(edges, nodes, k, **kw)


def minibatch(points: DataFrame, k: int, seed: int, head_rows: int, d: int, order_key=None, batch_size: int | None = None,
              cents: DataFrame | None = None) -> DataFrame:
    """A fit (Lloyd, or the given ``cents(centroid_id, x, n)``) on the first ``head_rows`` rows, then one partial
    update a batch of ``batch_size`` rows (default: as many as the head): the batch is assigned to the centres as
    they stand and each centre becomes the running mean of all it was given. Returns ``centroid_id, x, n``.

    A batch is one pass that assigns and adds up inside the tasks; the state, k centres, is on the driver."""
    key = order_key if order_key is not None else rand.uniform("id", f"mb:{seed}")
    size = batch_size or head_rows
    staged = StagedPoints(points.select("id", "x"), key)
    if cents is None:
        path = f"{checkpoint_dir(points.sparkSession).rstrip('/')}/minibatch-{uuid.uuid4().hex}"
        staged.rows(0, head_rows).write.parquet(path)  # the fit reads it many times
        cents = lloyd(points.sparkSession.read.parquet(path), k, seed, weight=None)
    state = sorted((r["centroid_id"], list(r["x"]), r["n"]) for r in cents.collect())
    ids = np.array([s[0] for s in state], np.int64)
    mat, n = np.array([s[1] for s in state], float).reshape(len(state), d), np.array([s[2] for s in state], np.int64)
    for lo in range(head_rows, staged.n, size):
        m, sx, _ = add_up(staged.run(lo, min(lo + size, staged.n), lambda ids_, named, x, row_ids, mat=mat.copy(): N.assign_sums(x, mat)), *mat.shape)
        hit = np.flatnonzero(m)
        mat[hit] = (mat[hit] * n[hit, None] + sx[hit]) / (n[hit] + m[hit])[:, None]
        n[hit] += m[hit]
    return points.sparkSession.createDataFrame([(int(c), [float(v) for v in x], int(m)) for c, x, m in zip(ids, mat, n)],
                                               "centroid_id long, x array<double>, n long")
