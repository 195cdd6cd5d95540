"""Distance joins: nearest centroid, k nearest neighbours, all pairs, radius join.

Spark has no kNN join, so the library chooses the strategy (Catalyst cannot):

* **broadcast index** - the searched side (centroids, landmarks, a bounded sample) is counted
  first; when ``rows * dim * 8`` fits ``max_broadcast_bytes`` it ships to every executor once
  and each query partition is scored by an Arrow-batched numpy kernel (``mapInPandas``).
  No pair table, no cross join, partitions of the query side scale out freely.
* **cells** - larger searched sides are cut into Voronoi cells around a bounded set of cell
  centres; queries probe their nearest cells, then a triangle-inequality bound decides
  exactly which further cells can still hold a closer point, so the result stays exact.

Distances are summed coordinate by coordinate in index order (same as the DuckDB oracle),
ties broken by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from potentia.functions import vec
from potentia.session import ship_package

DEFAULT_MAX_BROADCAST_BYTES = 256 * 1024 * 1024
# Above this many searched rows of low dimension a brute-force scan of the whole index per query costs
# more than the cell-pruned join, even when the index would fit in a broadcast.
DEFAULT_MAX_SCAN_ROWS = 50_000
_BLOCK_CELLS = 1 << 17  # query x index entries scored per numpy block (1 MB of doubles: stays in cache)
# From this length on, a matrix product screens the rows and few exact distances are summed; and cells
# around sampled centres prune so little that a scan of a broadcast index beats them at any size.
_SCREEN_DIM = 8
_SCREEN_CELLS = 1 << 21  # query x index entries screened per block (16 MB)
_CHUNKS = 24  # chunks that cells are cut into in all, about
_CHUNK_BYTES = 32 * 1024 * 1024  # vectors of a chunk
_PAIR_BLOCK = 4096  # rows of a block where all pairs are taken block by block, at least
_PAIR_BYTES = 4 * 1024 * 1024  # vectors of such a block, where there are more than _CHUNKS of them
_PAIR_SENT = 1_000_000  # rows, within _CHUNK_BYTES of vectors, that are sent to all pairs' tasks instead of their blocks


def spread(df: DataFrame) -> DataFrame:
    """Give a compute-bound kernel at least one input partition per core: a file with few
    row groups arrives in few splits. Round-robin only when needed (large inputs already
    have many splits); streaming frames are left as they are."""
    if df.isStreaming:
        return df
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


# --------------------------------------------------------------------------- numpy kernels
def _sq_dists(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(b, N) squared distances, summed over coordinates in index order."""
    out = np.zeros((q.shape[0], x.shape[0]))
    for j in range(q.shape[1]):
        diff = q[:, j][:, None] - x[:, j][None, :]
        out += diff * diff
    return out


def _topk_rows(dist: np.ndarray, k: int):
    """Row-wise k smallest with ties broken by column position (ids are sorted ascending).

    Returns (row, col, rank) arrays. Exact on ties: all values strictly below the k-th
    smallest are kept, then the lowest positions among those equal to it.
    """
    b, n = dist.shape
    k = min(k, n)
    if k <= 0 or b == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e
    if k == 1:  # argmin keeps the first (smallest-id) position among ties
        cols = dist.argmin(axis=1)
        rows = np.arange(b)
        ok = np.isfinite(dist[rows, cols])
        return rows[ok], cols[ok], np.ones(int(ok.sum()), dtype=np.int64)
    if k == n:
        sel = np.isfinite(dist)
    else:
        kth = np.partition(dist, k - 1, axis=1)[:, k - 1][:, None]
        less = dist < kth
        eq = dist == kth
        need = k - less.sum(axis=1, keepdims=True)
        sel = less | (eq & (np.cumsum(eq, axis=1) <= need))
        sel &= np.isfinite(dist)
    rows, cols = np.nonzero(sel)
    order = np.lexsort((cols, dist[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, rows, side="left")
    rank = np.arange(rows.size) - starts + 1
    return rows, cols, rank


def _screened_topk(q: np.ndarray, x: np.ndarray, size: np.ndarray, k: int, banned: np.ndarray | None):
    """(row, col, rank, d2) of each query's k nearest rows of ``x``, as ``_topk_rows(_sq_dists(q, x), k)``
    finds them, from a matrix product and the exact distances of the rows near its k-th value.

    ``size`` holds the rows' squared lengths. The product's distance and the one summed in index order
    differ by less than ``slack``, so a row outside the k-th value by more than twice that is not among the k.
    The k-th value itself is taken from the minima of groups of rows, which cannot lie below it.
    Returns None where there are too few rows for that, or where lengths overflow.
    """
    n, d = x.shape
    groups = n if k == 1 else max(256, 16 * k)
    length = (q * q).sum(1)
    if d < _SCREEN_DIM or n < 4 * max(256, 16 * k) or not (np.isfinite(size).all() and np.isfinite(length).all()):
        return None
    near = q @ x.T
    near *= -2.0
    near += size
    if banned is not None:
        near[banned] = np.inf
    if k == 1:
        bound = near.min(axis=1)
    else:
        wide = n // groups
        least = near[:, :groups * wide].reshape(len(q), groups, wide).min(axis=2)
        bound = np.partition(least, k - 1, axis=1)[:, k - 1]
    slack = 8 * (d + 4) * np.finfo(np.float64).eps * (length + size.max())
    rows, cols = np.divmod(np.flatnonzero(near <= (bound + 2 * slack)[:, None]), n)
    if banned is not None:
        real = np.isfinite(near[rows, cols])
        rows, cols = rows[real], cols[real]
    d2 = np.zeros(rows.size)
    for j in range(d):
        diff = q[rows, j] - x[cols, j]
        d2 += diff * diff
    order = np.lexsort((cols, d2, rows))
    rows, cols, d2 = rows[order], cols[order], d2[order]
    rank = np.arange(rows.size) - np.searchsorted(rows, rows, side="left") + 1
    first = rank <= k
    return rows[first], cols[first], rank[first], d2[first]


def _nearest_rows(q: np.ndarray, x: np.ndarray, size: np.ndarray | None, k: int, banned_of):
    """Blocks ``(start, row, col, rank, d2)`` of every query's k nearest rows; ``banned_of(start, end)`` marks
    pairs that do not count (or is None)."""
    n, d = x.shape if x.ndim == 2 else (0, 0)
    screen = size is not None and d >= _SCREEN_DIM
    step = max(1, (_SCREEN_CELLS if screen else _BLOCK_CELLS) // max(n, 1))
    for s in range(0, q.shape[0], step):
        qb = q[s:s + step]
        banned = banned_of(s, s + len(qb)) if banned_of else None
        got = _screened_topk(qb, x, size, k, banned) if screen else None
        if got is None:
            dist = _sq_dists(qb, x)
            if banned is not None:
                dist[banned] = np.inf
            r, c, rk = _topk_rows(dist, k)
            got = r, c, rk, dist[r, c]
        yield (s, *got)


def _stack(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack(series.to_numpy()).astype(np.float64, copy=False)


_FLAT_MAX_DIM = 512


def _flatten(df: DataFrame, d: int) -> DataFrame:
    """Ship vectors to Python workers as plain DOUBLE columns (zero-copy Arrow -> numpy)
    instead of an array column (one Python object per row)."""
    if d <= 0 or d > _FLAT_MAX_DIM:
        return df
    keep = [c for c in df.columns if c != "x"]
    return df.select(*keep, *[F.col("x")[i].alias(f"_x{i}") for i in range(d)])


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    if "x" in pdf.columns:
        return _stack(pdf["x"])
    cols = [c for c in pdf.columns if c.startswith("_x")]
    cols.sort(key=lambda c: int(c[2:]))
    return pdf[cols].to_numpy(dtype=np.float64)


def _knn_partition(batches, bc, k: int, exclude_self: bool, with_weight: bool, group: bool = False,
                   carry: tuple = ()):
    ids, mat, wts = bc.value[:3]
    groups = bc.value[3] if group else None
    n = ids.shape[0]
    size = (mat * mat).sum(axis=1) if n else None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        q = _matrix(pdf)
        qids = pdf["id"].to_numpy(dtype=np.int64)
        qw = pdf["weight"].to_numpy(dtype=np.float64) if with_weight else None
        qg = pdf["group"].to_numpy() if group else None

        def banned_of(a, b):
            mask = qids[a:b, None] == ids[None, :] if exclude_self else np.zeros((b - a, n), dtype=bool)
            return mask | (qg[a:b, None] != groups[None, :]) if group else mask

        for s, r, c, rk, d2 in _nearest_rows(q, mat, size, k, banned_of if exclude_self or group else None):
            r = r + s
            out = {"src": qids[r], "dst": ids[c], "d2": d2, "rank": rk.astype(np.int32)}
            if with_weight:
                out["src_weight"] = qw[r]
                out["dst_weight"] = wts[c]
            for col in carry:  # pass-through query columns (saves a join back on id)
                out[col] = pdf[col].to_numpy()[r]
            yield pd.DataFrame(out)


def _collect_index(index: DataFrame, max_bytes: int, max_rows: int | None = None, unless_wide: bool = False):
    """Size-checked collection of the searched side (count first, then Arrow). The side is
    persisted so the check and the collection evaluate its plan once. ``unless_wide`` lifts
    ``max_rows``, not ``max_bytes``, for vectors long enough to be screened."""
    index = index.persist()
    stats = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = int(stats["n"]), int(stats["d"] or 0)
    if n * max(d, 1) * 8 > max_bytes or (max_rows is not None and n > max_rows and not (unless_wide and d >= _SCREEN_DIM)):
        index.unpersist()
        return None, n, d
    cols = ["id", "x"] + [c for c in ("weight", "group") if c in index.columns]
    pdf = index.select(*cols).toPandas()
    index.unpersist()
    pdf = pdf.sort_values("id", kind="stable")
    ids = pdf["id"].to_numpy(dtype=np.int64)
    mat = _stack(pdf["x"]) if n else np.zeros((0, d))
    wts = pdf["weight"].to_numpy(dtype=np.float64) if "weight" in pdf else np.ones(n)
    if "group" in pdf:
        return (ids, mat, wts, pdf["group"].to_numpy()), n, d
    return (ids, mat, wts), n, d


def knn(queries: DataFrame, index: DataFrame, k: int, *, exclude_self: bool = False,
        with_weight: bool = False, max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
        cells: int | None = None, probes: int = 3, group: bool = False,
        max_scan_rows: int | None = None) -> DataFrame:
    """The k nearest ``index`` rows of every ``queries`` row.

    The index is broadcast and scanned up to ``max_broadcast_bytes`` and ``max_scan_rows`` rows (by default
    50,000 below 8 dimensions, any number from there on), beyond that it goes through ``knn_cells``.

    Both inputs carry ``id BIGINT, x ARRAY<DOUBLE>`` (and ``weight`` if ``with_weight``;
    ``group`` if ``group=True``, which restricts matches to equal groups, e.g. per label).
    Output: ``src, dst, d2, rank`` (+ ``src_weight, dst_weight``), ties by smaller id.
    """
    spark = queries.sparkSession
    ship_package(spark)
    rows = DEFAULT_MAX_SCAN_ROWS if max_scan_rows is None else max_scan_rows
    payload, n, d = _collect_index(index, max_broadcast_bytes, None if group else rows, unless_wide=max_scan_rows is None)
    if payload is None and group:
        raise ValueError("group-restricted kNN needs a broadcastable index")
    if payload is None:
        return knn_cells(queries, index, k, exclude_self=exclude_self, with_weight=with_weight,
                         cells=cells, probes=probes, max_broadcast_bytes=max_broadcast_bytes)
    bc = spark.sparkContext.broadcast(payload)
    schema = "src long, dst long, d2 double, rank int"
    if with_weight:
        schema += ", src_weight double, dst_weight double"
    cols = ["id", "x"] + (["weight"] if with_weight else []) + (["group"] if group else [])

    def run(batches):
        return _knn_partition(batches, bc, k, exclude_self, with_weight, group)

    return _flatten(spread(queries.select(*cols)), d).mapInPandas(run, schema)


def nearest_to_arrays(points: DataFrame, ids, mat, carry: tuple[str, ...] = ()) -> DataFrame:
    """J1 against a centroid state already held on the driver (bounded, e.g. the streaming
    k-means state): broadcast the arrays directly, no DataFrame round trip. ``carry`` columns
    of ``points`` are passed through, so callers need no join back on id."""
    order = np.argsort(np.asarray(ids, dtype=np.int64), kind="stable")
    ids = np.asarray(ids, dtype=np.int64)[order]
    mat = np.asarray(mat, dtype=np.float64)[order]
    ship_package(points.sparkSession)
    bc = points.sparkSession.sparkContext.broadcast((ids, mat, np.ones(ids.size)))
    types = dict(points.dtypes)
    extra = "".join(f", {c} {types[c]}" for c in carry)
    cols = ["id"] + (["x"] if "x" not in carry else []) + list(carry)
    src = spread(points.select(*cols))
    if "x" not in carry:
        src = _flatten(src, mat.shape[1])
    res = src.mapInPandas(lambda it: _knn_partition(it, bc, 1, False, False, carry=tuple(carry)),
                                           "src long, dst long, d2 double, rank int" + extra)
    return res.select(F.col("src").alias("id"), F.col("dst").alias("centroid_id"), "d2", *carry)


def assign_sums(q: np.ndarray, mat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, coordinate sums, sum of d2) of the rows of ``q`` nearest to each row of ``mat``."""
    m, d = mat.shape
    step = max(1, _BLOCK_CELLS // max(m, 1))
    cnt = np.zeros(m, dtype=np.int64)
    sx = np.zeros((m, d))
    sd2 = np.zeros(m)
    for s in range(0, q.shape[0], step):
        dist = _sq_dists(q[s:s + step], mat)
        a = dist.argmin(axis=1)  # first (smallest-id) centre among ties
        dm = dist[np.arange(a.size), a]
        cnt += np.bincount(a, minlength=m)
        sd2 += np.bincount(a, weights=dm, minlength=m)
        for j in range(d):
            sx[:, j] += np.bincount(a, weights=q[s:s + step, j], minlength=m)
    return cnt, sx, sd2


def _assign_sum_partition(batches, bc):
    ids, mat, _ = bc.value
    for pdf in batches:
        if len(pdf) == 0:
            continue
        cnt, sx, sd2 = assign_sums(_matrix(pdf), mat)
        hit = np.nonzero(cnt)[0]
        yield pd.DataFrame({"centroid_id": ids[hit], "m": cnt[hit], "sx": list(sx[hit]), "sd2": sd2[hit]})


def assign_and_sum(points: DataFrame, ids, mat) -> DataFrame:
    """J1 + A1/A2/A4 in one pass with map-side combine: every Arrow batch is assigned to the
    nearest centre and reduced to per-centre partials (count, coordinate sums, sum of d2)
    inside the kernel, so only <= centres rows per batch leave Python; Spark adds partials.
    Returns ``centroid_id, m, sx, sd2`` for the non-empty cells."""
    ship_package(points.sparkSession)
    order = np.argsort(np.asarray(ids, dtype=np.int64), kind="stable")
    ids = np.asarray(ids, dtype=np.int64)[order]
    mat = np.asarray(mat, dtype=np.float64)[order]
    d = mat.shape[1]
    bc = points.sparkSession.sparkContext.broadcast((ids, mat, None))
    src = _flatten(spread(points.select("id", "x")), d)
    part = src.mapInPandas(lambda it: _assign_sum_partition(it, bc),
                           "centroid_id long, m long, sx array<double>, sd2 double")
    return part.groupBy("centroid_id").agg(
        F.sum("m").alias("m"), F.array(*[F.sum(F.col("sx")[j]) for j in range(d)]).alias("sx"),
        F.sum("sd2").alias("sd2"))


def nearest(points: DataFrame, centroids: DataFrame, *, centroid_id: str = "centroid_id",
            max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Nearest centroid per point -> ``id, centroid_id, d2`` (tie -> smaller centroid id)."""
    cents = centroids.select(F.col(centroid_id).alias("id"), "x")
    res = knn(points.select("id", "x"), cents, 1, max_broadcast_bytes=max_broadcast_bytes)
    return res.select(F.col("src").alias("id"), F.col("dst").alias("centroid_id"), "d2")


def self_knn(points: DataFrame, k: int, **kw) -> DataFrame:
    """K nearest other points (self excluded by id, not by position: D22)."""
    return knn(points, points, k, exclude_self=True, **kw)


def closest_to(points: DataFrame, target: list[float], dist=vec.sq_dist,
               ignore: DataFrame | None = None) -> DataFrame:
    """The single closest point to a coordinate, honouring an ignore list; tie -> lowest id."""
    if ignore is not None:
        points = points.join(ignore.select("id"), "id", "left_anti")
    t = F.array(*[F.lit(float(v)) for v in target])
    return points.agg(F.min_by("id", F.struct(dist("x", t), F.col("id"))).alias("id"),
                      F.min(dist("x", t)).alias("dist"))


def members(assign: DataFrame, cell: int) -> DataFrame:
    """Ids whose nearest centre is ``cell``."""
    return assign.where(F.col("centroid_id") == F.lit(cell))


# ------------------------------------------------------------------------ all pairs (bounded)
def _pairs_partition(batches, bc, max_d2: float | None):
    ids, mat, _ = bc.value
    for pdf in batches:
        if len(pdf) == 0:
            continue
        q = _stack(pdf["x"])
        qids = pdf["id"].to_numpy(dtype=np.int64)
        step = max(1, _BLOCK_CELLS // max(ids.shape[0], 1))
        for s in range(0, q.shape[0], step):
            dist = _sq_dists(q[s:s + step], mat)
            keep = qids[s:s + step][:, None] < ids[None, :]
            if max_d2 is not None:
                keep &= dist <= max_d2
            r, c = np.nonzero(keep)
            yield pd.DataFrame({"id1": qids[s:s + step][r], "id2": ids[c], "d2": dist[r, c]})


def _block_pairs(points: DataFrame, n: int, d: int):
    """Rows grouped by every pair of hashed blocks ``_a <= _b``: a pair of points meets in one group, a
    group holds two blocks, and each row is sent to as many groups as there are blocks, about ``_CHUNKS``."""
    blocks = -(-n // max(_PAIR_BLOCK, min(-(-n // _CHUNKS), _PAIR_BYTES // (8 * max(d, 1)))))
    rows = points.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_own"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other")).drop("_other")
    # groups are few bytes and much arithmetic: the number of tasks is not left to the size of the shuffle
    tasks = min(blocks * (blocks + 1) // 2, 8 * points.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(1, tasks), "_a", "_b").groupBy("_a", "_b")


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows) of the two blocks of a group; the same ones twice on the diagonal."""
    ids, x, own = pdf["id"].to_numpy(dtype=np.int64), _stack(pdf["x"]), pdf["_own"].to_numpy()
    left, right = own == pdf["_a"].iloc[0], own == pdf["_b"].iloc[0]
    return ids[left], x[left], ids[right], x[right]


def _block_sides(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    pdf = pa.Table.from_batches(list(batches)).to_pandas()  # two blocks
    return (*_sides(pdf), bool(pdf["_a"].iloc[0] == pdf["_b"].iloc[0]))


def _pairs_group(batches, max_d2: float | None):
    """The pairs of a group, leaving it as they are made: a group has many millions."""
    lid, lx, rid, rx, diagonal = _block_sides(batches)
    step = max(1, _BLOCK_CELLS // max(len(rid), 1))
    for s in range(0, len(lid), step):
        dist = _sq_dists(lx[s:s + step], rx)
        keep = lid[s:s + step][:, None] < rid[None, :] if diagonal else np.ones(dist.shape, bool)
        if max_d2 is not None:
            keep &= dist <= max_d2
        i, j = np.nonzero(keep)
        p, q = lid[s:s + step][i], rid[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(dist[i, j])], ["id1", "id2", "d2"])


def _unit_pairs(batches, bc, blocks: int, max_d2: float | None):
    """The pairs of the blocks ``a`` and ``a + k`` (in a ring) of each unit ``a + blocks k``, of rows in the order of their ids."""
    ids, mat, _ = bc.value
    bounds = [len(ids) * t // blocks for t in range(blocks + 1)]
    for batch in batches:
        for u in batch.column("id").to_pylist():
            k, a = divmod(u, blocks)
            if 2 * k == blocks and a >= k:
                continue  # met from the other side
            a, b = sorted((a, (a + k) % blocks))
            lid, rid, rx = ids[bounds[a]:bounds[a + 1]], ids[bounds[b]:bounds[b + 1]], mat[bounds[b]:bounds[b + 1]]
            step = max(1, _BLOCK_CELLS // max(len(rid), 1))
            for s in range(0, len(lid), step):
                dist = _sq_dists(mat[bounds[a] + s:min(bounds[a] + s + step, bounds[a + 1])], rx)
                keep = lid[s:s + step][:, None] < rid[None, :]
                if max_d2 is not None:
                    keep &= dist <= max_d2
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(lid[s:s + step][i]), pa.array(rid[j]), pa.array(dist[i, j])], ["id1", "id2", "d2"])


def all_pairs(points: DataFrame, *, max_points: int = 20_000, max_d2: float | None = None) -> DataFrame:
    """J4 (condensed, id1 < id2) and J5 (``max_d2`` = r^2): distances of every pair.

    Up to ``max_points`` rows the set is broadcast once and scored where its rows lie; beyond, up to ``_PAIR_SENT`` rows, it is broadcast
    and each task takes pairs of its blocks, so nothing is exchanged; a larger one is dealt to groups of two
    blocks. The result is the same; its size is the pairs', so the radius join on
    large inputs is :func:`radius_join_grid`."""
    spark = points.sparkSession
    ship_package(spark)
    payload, n, d = _collect_index(points, DEFAULT_MAX_BROADCAST_BYTES, max_points)
    if payload is None:
        payload, n, d = _collect_index(points, _CHUNK_BYTES, _PAIR_SENT)
        if payload is not None:
            sent, blocks = spark.sparkContext.broadcast(payload), -(-n // _PAIR_BLOCK)
            units = blocks * (blocks // 2 + 1)
            tasks = min(units, 8 * spark.sparkContext.defaultParallelism)
            return spark.range(0, units, 1, tasks).mapInArrow(lambda it: _unit_pairs(it, sent, blocks, max_d2), "id1 long, id2 long, d2 double")

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _pairs_group(batches, max_d2)

        return _block_pairs(points, n, d).applyInArrow(pairs, "id1 long, id2 long, d2 double")
    bc = points.sparkSession.sparkContext.broadcast(payload)
    return points.select("id", "x").mapInPandas(
        lambda it: _pairs_partition(it, bc, max_d2), "id1 long, id2 long, d2 double")


def _extremes(q: np.ndarray, x: np.ndarray, banned: np.ndarray, lo: float, hi: float) -> tuple[float, float]:
    """(smallest positive, largest) of ``lo``, ``hi`` and the squared distances of pairs not ``banned``, as ``_sq_dists`` sums
    them. From ``_SCREEN_DIM`` coordinates on a matrix product tells the pairs that can change either; only these are summed."""
    d = q.shape[1] if q.ndim == 2 else 0
    length, size = (q * q).sum(1), (x * x).sum(1)
    if d < _SCREEN_DIM or not (np.isfinite(length).all() and np.isfinite(size).all()):
        dist = _sq_dists(q, x)[~banned]
    else:
        near = q @ x.T
        near *= -2.0
        near += size
        near += length[:, None]
        slack = 8 * (d + 4) * np.finfo(np.float64).eps * (length.max(initial=0.0) + size.max(initial=0.0))
        sure = near > 2 * slack  # positive beyond rounding: the least of these bounds the result
        sure &= ~banned
        bound = min(lo, float(near.min(where=sure, initial=np.inf)) + slack)
        far = max(hi, float(near.max(where=~banned, initial=-np.inf)) - slack)
        rows, cols = np.nonzero(((near <= bound + slack) | (near >= far - slack)) & ~banned)
        dist = np.zeros(rows.size)
        for j in range(d):
            diff = q[rows, j] - x[cols, j]
            dist += diff * diff
    return min(lo, float(dist[dist > 0].min(initial=np.inf))), max(hi, float(dist.max(initial=-np.inf)))


def _minmax_batch(lo: float, hi: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v if np.isfinite(v) else None], pa.float64()) for v in (lo, hi)], ["min_d2", "max_d2"])


def _minmax_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lid, lx, rid, rx, _ = _block_sides(batches)
    lo, hi = np.inf, -np.inf
    step = max(1, (_SCREEN_CELLS if lx.shape[1] >= _SCREEN_DIM else _BLOCK_CELLS) // max(len(rid), 1))
    for s in range(0, len(lid), step):
        lo, hi = _extremes(lx[s:s + step], rx, lid[s:s + step][:, None] == rid[None, :], lo, hi)
    yield _minmax_batch(lo, hi)


def _minmax_partition(batches, bc):
    ids, mat, _ = bc.value
    lo, hi = np.inf, -np.inf
    for pdf in batches:
        if len(pdf) == 0:
            continue
        q = _stack(pdf["x"])
        qids = pdf["id"].to_numpy(dtype=np.int64)
        step = max(1, (_SCREEN_CELLS if q.shape[1] >= _SCREEN_DIM else _BLOCK_CELLS) // max(ids.shape[0], 1))
        for s in range(0, q.shape[0], step):
            lo, hi = _extremes(q[s:s + step], mat, qids[s:s + step][:, None] == ids[None, :], lo, hi)
    yield pd.DataFrame({"min_d2": [lo if np.isfinite(lo) else None],
                        "max_d2": [hi if np.isfinite(hi) else None]})


def pairwise_min_max(points: DataFrame, *, max_points: int = 50_000) -> DataFrame:
    """Min positive and max squared distance over distinct pairs (D8 intended),
    without materialising pairs: partial min/max per partition (or, above ``max_points`` rows, per pair of
    blocks), then a global aggregate."""
    ship_package(points.sparkSession)
    payload, n, d = _collect_index(points, DEFAULT_MAX_BROADCAST_BYTES, max_points)
    if payload is None:
        part = _block_pairs(points, n, d).applyInArrow(_minmax_group, "min_d2 double, max_d2 double")
    else:
        bc = points.sparkSession.sparkContext.broadcast(payload)
        part = points.select("id", "x").mapInPandas(lambda it: _minmax_partition(it, bc), "min_d2 double, max_d2 double")
    return part.agg(F.min("min_d2").alias("min_d2"), F.max("max_d2").alias("max_d2"))


# ------------------------------------------------------------------------ radius join on a grid
def _near(lid, lx, rid, rx, r: float, same: bool):
    """The pairs of two sets of rows within ``r``, leaving as they are made; ``same``: both are one set, each pair once. Rows
    lie in the order of the coordinate that spreads most, so a few of them meet a run of the others."""
    if not len(lid) or not len(rid):
        return
    c = int((rx.max(axis=0) - rx.min(axis=0)).argmax())
    turn = np.argsort(rx[:, c], kind="stable")
    rid, rx = rid[turn], rx[turn]
    lid, lx = (rid, rx) if same else (lid[t := np.argsort(lx[:, c], kind="stable")], lx[t])
    r2, reach = r * r, r * (1 + 1e-9)
    step = max(1, min(256, _BLOCK_CELLS // len(rid)))
    for s in range(0, len(lid), step):
        q = lx[s:s + step]
        slack = 1e-9 * max(abs(q[0, c]), abs(q[-1, c]))
        a, b = np.searchsorted(rx[:, c], [q[0, c] - reach - slack, q[-1, c] + reach + slack])
        a = max(a, s) if same else a
        for t in range(a, b, max(1, _BLOCK_CELLS // len(q))):
            e = min(b, t + max(1, _BLOCK_CELLS // len(q)))
            dist = _sq_dists(q, rx[t:e])
            i, j = np.nonzero(dist <= r2)
            d2, p, o = dist[i, j], lid[i + s], rid[j + t]
            keep = (p != o) & (j + t > i + s) if same else p != o
            if not keep.all():
                d2, p, o = d2[keep], p[keep], o[keep]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, o)), pa.array(np.maximum(p, o)), pa.array(d2)], ["id1", "id2", "d2"])


def radius_join_grid(points: DataFrame, r: float, *, tile_rows: int = 512, chunk_rows: int = 1 << 16) -> DataFrame:
    """J5 at scale for low dimension: points meet in tiles of a grid with cells of side r.

    A pair lies in cells next to each other. A point goes to the tile of its own cell and, as a guest, to the earlier ones
    (in their order) among the tiles of its 3^d neighbour cells, so two points meet in the earlier of their tiles and only
    nearby pairs are ever made (no cross join). A tile is one cell where cells hold ``tile_rows`` points, else
    several; one with more than ``chunk_rows`` points is many groups, each two chunks of it. Pairs leave a group as
    they are made. Output ``id1 < id2, d2 <= r^2``.
    """
    ship_package(points.sparkSession)
    d = points.agg(F.max(F.size("x"))).first()[0]
    if d > 6:  # 3^d cells around a point: a low-dimension method (use radius.radius_join above that)
        raise ValueError(f"radius_join_grid is for low dimension (d <= 6), got d={d}")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    base = points.where(F.col("id").isNotNull() & (F.size("x") == d) & finite).select(
        F.col("id").cast("long").alias("id"), "x", F.transform("x", lambda v: F.floor(v / F.lit(float(r)))).alias("cell"))
    held = base.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")).first()
    side = max(1, int((tile_rows * held["cells"] / held["n"]) ** (1 / d))) if held["n"] and d else 1  # cells of a tile, along each axis
    offsets = [[]]
    for _ in range(d):
        offsets = [o + [s] for o in offsets for s in (-1, 0, 1)]
    around = [F.array(*[F.floor((F.col("cell")[k] + F.lit(s)) / F.lit(side)) for k, s in enumerate(o)]) for o in offsets]
    own = around[len(offsets) // 2]  # no offset
    sent = (base.select("id", "x", own.alias("_own"), F.array_distinct(F.array(*around)).alias("_near"))
            .select("id", "x", "_own", F.explode("_near").alias("tile")).where(F.col("tile") <= F.col("_own"))
            .select("id", "x", "tile", (F.col("tile") == F.col("_own")).alias("home")))
    chunks = F.ceil(F.count(F.lit(1)) / F.lit(chunk_rows)).cast("int")
    hot = sent.groupBy("tile").agg(chunks.alias("chunks")).where("chunks > 1").collect()  # a row ``chunk_rows`` points at most
    if hot:
        sent = sent.join(F.broadcast(points.sparkSession.createDataFrame(hot, "tile array<long>, chunks int")), "tile", "left")
    else:
        sent = sent.withColumn("chunks", F.lit(1))
    sent = (sent.withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            .withColumn("part", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("id", "x", "tile", "home", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()  # two chunks
        ids, part = t["id"].to_numpy(), t["part"].to_numpy()
        x = t["x"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        home = t["home"].to_numpy(zero_copy_only=False).astype(bool)
        first = part == t["a"][0].as_py()
        if t["a"][0] == t["b"][0]:
            yield from _near(ids[home], x[home], ids[home], x[home], r, True)
            sides = [(home, ~home)]
        else:  # two guests meet elsewhere
            sides = [(first & home, ~first), (first & ~home, ~first & home)]
        for left, right in sides:
            yield from _near(ids[left], x[left], ids[right], x[right], r, False)

    # groups are few bytes and much arithmetic: the number of tasks is not left to the size of the shuffle
    tasks = max(8 * points.sparkSession.sparkContext.defaultParallelism, -(-int(held["n"] or 0) // chunk_rows))
    return sent.repartition(tasks, "tile", "a", "b").groupBy("tile", "a", "b").applyInArrow(meet, "id1 long, id2 long, d2 double")


# ------------------------------------------------------------------------ exact kNN over cells
def _extra_cells_partition(batches, bc, probes: int, k: int):
    cids, cmat, radius = bc.value
    for pdf in batches:
        if len(pdf) == 0:
            continue
        q = _stack(pdf["qx"])
        qids = pdf["qid"].to_numpy(dtype=np.int64)
        b = pdf["b"].to_numpy(dtype=np.float64)
        got = pdf["got"].to_numpy(dtype=np.int64)
        step = max(1, _BLOCK_CELLS // max(cids.shape[0], 1))
        for s in range(0, q.shape[0], step):
            cd2 = _sq_dists(q[s:s + step], cmat)
            # rank of every centre per query, ties by centre id (same order as pass 1)
            order = np.lexsort((np.broadcast_to(np.arange(cids.size), cd2.shape), cd2), axis=1)
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(cids.size)[None, :].repeat(cd2.shape[0], 0), axis=1)
            # a little slack: rounding must not lose a row that ties at the k-th distance
            lb = np.maximum(np.sqrt(cd2) * (1 - 1e-9) - radius[None, :] * (1 + 1e-9), 0.0) ** 2
            need = (rank >= probes) & ((lb <= b[s:s + step][:, None] * (1 + 1e-9)) | (got[s:s + step][:, None] < k))
            r, c = np.nonzero(need)
            yield pd.DataFrame({"qid": qids[s:s + step][r], "cell": cids[c]})


def knn_cells(queries: DataFrame, index: DataFrame, k: int, *, exclude_self: bool = False,
              with_weight: bool = False, cells: int | None = None, probes: int = 3,
              max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES, seed: int = 17,
              chunk_rows: int | None = None) -> DataFrame:
    """Exact kNN for a searched side too large to broadcast (J9 made exact).

    1. ``cells`` centres = a hash-uniform sample of the index (bounded count, broadcast).
    2. Every index row gets its cell (J1) and every cell its radius (max distance to centre).
    3. Every query is scored against the rows of its ``probes`` nearest cells (equi join).
    4. With b = its k-th distance so far, another cell c can only hold a closer row when
       ``(|q - centre_c| - radius_c)^2 <= b``; an Arrow kernel emits exactly those (query, cell)
       pairs and they are scored in a second pass. The result is exact, never capped.
    Cells are split into hashed chunks of at most ``chunk_rows`` rows, so a hot cell (a third
    of the data) spreads over many join tasks instead of one. A query travels once for each chunk it needs, and a row
    once for each ``chunk_rows`` queries of its cell: the default is ``_CHUNKS`` chunks of all rows, within
    4,096 rows and ``_CHUNK_BYTES`` of vectors, so that neither number grows with the rows.
    """
    from potentia.operators.points import sample_k  # local import: avoid cycle

    spark = queries.sparkSession
    ship_package(spark)
    n_index = index.count()
    if chunk_rows is None:
        width = index.select(F.size("x")).first()
        chunk_rows = max(4096, min(-(-n_index // _CHUNKS), _CHUNK_BYTES // (8 * max(width[0] if width and width[0] else 1, 1))))
    # centres stay broadcastable (<= the scan limit), so assigning rows to cells never recurses
    cells = cells or min(max(16, int(np.sqrt(max(n_index, 1)))), DEFAULT_MAX_SCAN_ROWS)
    cents = sample_k(index.select("id", "x"), cells, seed)
    assign = nearest(index.select("id", "x"), cents.withColumnRenamed("id", "centroid_id"),
                     max_broadcast_bytes=max_broadcast_bytes)
    idx = index.select(*(["id", "x"] + (["weight"] if with_weight else []))).join(assign, "id")
    stats = idx.groupBy("centroid_id").agg(F.max(F.sqrt("d2")).alias("radius"),
                                           F.count(F.lit(1)).alias("size"))
    stats = stats.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(chunk_rows))))
    stats_pdf = stats.toPandas()  # one row per cell: bounded by ``cells``
    cent_pdf = cents.toPandas().merge(stats_pdf, left_on="id", right_on="centroid_id", how="left")
    cent_pdf["radius"] = cent_pdf["radius"].fillna(0.0)
    cent_pdf = cent_pdf.sort_values("id")
    bc = spark.sparkContext.broadcast((cent_pdf["id"].to_numpy(dtype=np.int64), _stack(cent_pdf["x"]),
                                       cent_pdf["radius"].to_numpy(dtype=np.float64)))
    chunks = spark.createDataFrame(stats_pdf[["centroid_id", "chunks"]]).withColumnRenamed("centroid_id", "cell")

    idx = (idx.join(F.broadcast(chunks.withColumnRenamed("cell", "centroid_id")), "centroid_id")
           .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
           .select(F.col("centroid_id").alias("cell"), "chunk", F.col("id").alias("dst"),
                   F.col("x").alias("dx"), *([F.col("weight").alias("dst_weight")] if with_weight else [])))
    q = queries.select(F.col("id").alias("qid"), F.col("x").alias("qx"),
                       *([F.col("weight").alias("src_weight")] if with_weight else []))

    qmax = chunk_rows  # queries per scoring group; hot cells get their query side salted
    d = int(cent_pdf["x"].map(len).max()) if len(cent_pdf) else 0
    qflat = _flatten(q.withColumnRenamed("qx", "x"), d).withColumnRenamed("id", "qid")
    iflat = _flatten(idx.withColumnRenamed("dx", "x"), d)
    out_schema = "src long, dst long, d2 double" + (", src_weight double, dst_weight double" if with_weight else "")

    def kernel(key, qp: pd.DataFrame, ip: pd.DataFrame) -> pd.DataFrame:
        if len(qp) == 0 or len(ip) == 0:
            return pd.DataFrame({c: [] for c in ["src", "dst", "d2"] + (["src_weight", "dst_weight"] if with_weight else [])})
        qm, im = _matrix(qp), _matrix(ip)
        qids = qp["qid"].to_numpy(dtype=np.int64)
        order = np.argsort(ip["dst"].to_numpy(dtype=np.int64), kind="stable")
        im = im[order]
        iids = ip["dst"].to_numpy(dtype=np.int64)[order]
        banned_of = (lambda a, b: qids[a:b, None] == iids[None, :]) if exclude_self else None
        found = [(s + r, c, d2) for s, r, c, _, d2 in _nearest_rows(qm, im, (im * im).sum(axis=1), k, banned_of)]
        r, c, d2 = (np.concatenate(part) for part in zip(*found))
        out = {"src": qids[r], "dst": iids[c], "d2": d2}
        if with_weight:
            out["src_weight"] = qp["src_weight"].to_numpy()[r]
            out["dst_weight"] = ip["dst_weight"].to_numpy()[order][c]
        return pd.DataFrame(out)

    def score(cands: DataFrame) -> DataFrame:
        """Per (cell, chunk, salt) group: numpy distances + top-k of every query in it."""
        load_ = cands.groupBy("cell").agg(F.count(F.lit(1)).alias("_ql"))  # <= cells rows
        plan = (chunks.join(load_, "cell")
                .select("cell", "chunks", F.greatest(F.lit(1), F.ceil(F.col("_ql") / F.lit(qmax))).cast("int").alias("salts")))
        qs = (cands.join(F.broadcast(plan), "cell")
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .withColumn("salt", F.pmod(F.xxhash64("qid"), F.col("salts")).cast("int"))
              .select("cell", "chunk", "salt", "qid")
              .join(qflat, "qid"))
        ix = (iflat.join(F.broadcast(plan.select("cell", "salts")), "cell")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
              .drop("salts"))
        g = qs.groupBy("cell", "chunk", "salt").cogroup(ix.groupBy("cell", "chunk", "salt"))
        return g.applyInPandas(kernel, out_schema)

    def top(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("src").orderBy("d2", "dst")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    near = knn(queries.select("id", "x"), cents, probes, max_broadcast_bytes=max_broadcast_bytes)
    first = top(score(near.select(F.col("src").alias("qid"), F.col("dst").alias("cell")))).persist()
    bound = first.groupBy("src").agg(F.max("d2").alias("b"), F.count(F.lit(1)).alias("got"))
    qb = (q.join(bound.withColumnRenamed("src", "qid"), "qid", "left")
          .select("qid", "qx", F.coalesce("b", F.lit(float("inf"))).alias("b"),
                  F.coalesce("got", F.lit(0)).cast("long").alias("got")))
    extra = qb.mapInPandas(lambda it: _extra_cells_partition(it, bc, probes, k), "qid long, cell long")
    return top(first.drop("rank").unionByName(score(extra)))


def neighbour_cells(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """J13 seen by the data: pairs of centres that are the two nearest of some point. The ridges
    themselves, also where no point lies, are ``voronoi.ridges``."""
    cents = centroids.select(F.col("centroid_id").alias("id"), "x")
    two = knn(points.select("id", "x"), cents, 2)
    pairs = (two.groupBy("src").agg(F.min("dst").alias("c1"), F.max("dst").alias("c2"),
                                    F.count(F.lit(1)).alias("n"))
             .where(F.col("n") == 2))
    return pairs.select("c1", "c2").distinct()
