"""Hard negatives by inner product from cover trees over norm-augmented candidates.

A candidate x gets one more coordinate, sqrt(M^2 - |x|^2), so that all candidates lie on a sphere of
radius M and a query (with 0 there) is the nearer the larger the inner product. A node of a tree
covers its members within a radius, so their inner products with a query lie between
|q| M cos(t + r) and |q| M cos(t - r), with t the angle between query and centre and r the angle
of the radius. Each level of a tree is a net of its parent's members, with radii that shrink by
``BASE`` and centres farther apart than that; the parent's centre is its first child's centre.

Candidates are dealt to cells around a bounded sample of centres by label bucket, cells to chunks of at most
``chunk_rows``, and each chunk is one tree, built in its own task and written. A search visits each query's
best cell first; with the k-th best score of each window it then visits exactly the cells whose
bounds can still hold a better one. Inside a tree, blocks of queries go down level by level,
dropping nodes outside all their windows, and visit the remaining leaves best first in growing
waves; members are verified by their integer inner product. Nothing is approximate.

The windows of negatives come from the scores of the positives, searched first. Equal rows (label
and vector) can fill at most the first k places by vec_id, so only each such group's k smallest ids are
candidates, and equal anchors are searched once.

Defined results: rows with a null vec_id, label or vector or with null or non-finite components take no
part, nor do components whose scaled value exceeds 2^28; zero vectors take part; a row repeated as a
whole is one row; different rows with one vec_id are rows of their own, and none is the other's
positive; vectors of different length do not meet; ties go to the smaller vec_id; an anchor without
positives or without rows in a window has no result rows; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from potentia.llm.textio import stage

BASE = 1.25
_LEAF = 64
_FAN = 64
_BUCKETS = 64  # label buckets
_MAX_CELLS = 4096
_QUERIES = 2048
_LIMIT = 1 << 28


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id, label, x): usable rows, once each, with integer components floor(factor * x)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    v = v.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    v = v.where(~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > float(_LIMIT / factor))))
    return v.select("vec_id", "label", F.transform("embedding", lambda c: F.floor(c.cast("double") * factor)).alias("x")).distinct()


# ------------------------------------------------------------------------ one tree
def build(points: np.ndarray) -> dict[str, np.ndarray]:
    """Cover tree over augmented ``points``: member order and, per node, centre (a row), covering radius,
    member range, parent and level; nodes are listed level by level."""
    order = np.arange(len(points))

    def spans(rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.square(points[rows] - points[centre]).sum(axis=1))

    first = int(np.square(points - points.mean(axis=0)).sum(axis=1).argmin())
    level = [(first, float(spans(order, first).max()), 0, len(points), -1)]
    centre, radius, start, end, parent, depth, leaf = [], [], [], [], [], [], []
    d = 0
    while level:
        below = []
        for c, r, s, e, up in level:
            me = len(centre)
            centre.append(c)
            radius.append(r)
            start.append(s)
            end.append(e)
            parent.append(up)
            depth.append(d)
            leaf.append(e - s <= _LEAF or r == 0.0)
            if leaf[-1]:
                continue
            rows = order[s:e]
            near = spans(rows, c)
            net, own = [c], np.zeros(e - s, np.int64)
            while len(net) < _FAN and near.max() > r / BASE:  # farthest-first net
                net.append(int(rows[near.argmax()]))
                away = spans(rows, net[-1])
                closer = away < near
                near[closer], own[closer] = away[closer], len(net) - 1
            by = np.argsort(own, kind="stable")
            order[s:e], near, own = rows[by], near[by], own[by]
            cuts = np.searchsorted(own, np.arange(len(net) + 1))
            for k, child in enumerate(net):
                if cuts[k] < cuts[k + 1]:
                    below.append((child, float(near[cuts[k]:cuts[k + 1]].max()), s + int(cuts[k]), s + int(cuts[k + 1]), me))
        level, d = below, d + 1
    return {"order": order, "centre": np.array(centre), "radius": np.array(radius), "start": np.array(start), "end": np.array(end),
            "parent": np.array(parent), "level": np.array(depth), "leaf": np.array(leaf)}


def product(q: np.ndarray, x: np.ndarray, sphere: float) -> np.ndarray:
    """Exact integer inner products, as doubles or longs."""
    if sphere < 2.0 ** 53:  # no partial sum exceeds |q| |x|
        return q @ x.T
    return q.astype(np.int64) @ x.astype(np.int64).T


def bounds(ip: np.ndarray, size: np.ndarray, radius: np.ndarray, sphere: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each query (norm ``size``) with anything in each ball."""
    m = np.sqrt(sphere)
    scale = np.maximum(size[:, None] * m, 1e-300)
    t = np.arccos(np.clip(ip / scale, -1.0, 1.0))
    r = 2.0 * np.arcsin(np.clip(radius / (2.0 * m), 0.0, 1.0))[None, :]
    slack = 1e-6 * scale + 1e-3
    return scale * np.cos(np.minimum(t + r, np.pi)) - slack, scale * np.cos(np.maximum(t - r, 0.0)) + slack


def reaches(least: np.ndarray, most: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether a ball's range meets some window: bounds (queries, balls), windows (queries, windows)."""
    out = np.zeros(least.shape, bool)
    for j in range(lo.shape[1]):
        out |= (most >= lo[:, j, None]) & (least <= hi[:, j, None]) & (lo[:, j] <= hi[:, j])[:, None]
    return out


def _best(q, w, s, ids, k):
    """The first k of each (query, window) by score, then id; repeated ids count once."""
    order = np.lexsort((ids, -s, w, q))
    q, w, s, ids = q[order], w[order], s[order], ids[order]
    if len(q):
        again = np.append(False, (q[1:] == q[:-1]) & (w[1:] == w[:-1]) & (s[1:] == s[:-1]) & (ids[1:] == ids[:-1]))
        q, w, s, ids = q[~again], w[~again], s[~again], ids[~again]
        new = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (w[1:] != w[:-1])))
        rank = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
        keep = rank < k
        q, w, s, ids = q[keep], w[keep], s[keep], ids[keep]
    return q, w, s, ids


def search_tree(tree: dict, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, own: np.ndarray,
                lo: np.ndarray, hi: np.ndarray, k: int, same: bool, sphere: float):
    """(query, window, score, id) arrays: the k best members in each window [lo, hi] of each query among
    those of the query's label (``same``) or of other labels. ``x``, ``ids`` and ``labels`` are in tree order."""
    size = np.sqrt(np.square(q.astype(np.float64)).sum(axis=1))
    n = len(tree["centre"])
    least, most = np.full((len(q), n), -np.inf), np.full((len(q), n), np.inf)
    live = np.zeros((len(q), n), bool)
    lo = lo.astype(np.float64).copy()
    for level in range(int(tree["level"][-1]) + 1):  # whole levels at once, only below live parents
        at = np.flatnonzero(tree["level"] == level)
        if level:
            at = at[live[:, tree["parent"][at]].any(axis=0)]
        if not len(at):
            break
        a, b = bounds(product(q, tree["points"][at], sphere), size, tree["radius"][at], sphere)
        if level:
            up = tree["parent"][at]
            a, b = np.maximum(a, least[:, up]), np.minimum(b, most[:, up])
        least[:, at], most[:, at] = a, b
        live[:, at] = reaches(a, b, lo, hi) & (live[:, tree["parent"][at]] if level else True)
    leaves = np.flatnonzero(tree["leaf"])
    least, most, live = least[:, leaves], most[:, leaves], live[:, leaves]
    first = np.argsort(np.where(live, -most, np.inf), axis=1, kind="stable")  # best first
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    at, wave = 0, 1
    while at < len(leaves):
        pick = first[:, at:at + wave]
        rows = np.repeat(np.arange(len(q)), pick.shape[1])
        cols = pick.ravel()
        open_ = live[rows, cols] & np.any((most[rows, cols, None] >= lo[rows]) & (least[rows, cols, None] <= hi[rows]) & (lo[rows] <= hi[rows]), axis=1)
        rows, cols = rows[open_], cols[open_]
        by = np.argsort(cols, kind="stable")
        rows, cols = rows[by], cols[by]
        cuts = np.flatnonzero(np.append(True, cols[1:] != cols[:-1])) if len(cols) else np.zeros(0, np.int64)
        found = [kept]
        for s, e in zip(cuts, np.append(cuts[1:], len(cols))):
            a, b = tree["start"][leaves[cols[s]]], tree["end"][leaves[cols[s]]]
            who = rows[s:e]
            score = product(q[who], x[a:b], sphere)
            fits = (own[who][:, None] == labels[None, a:b]) == same
            for j in range(lo.shape[1]):
                i, c = np.nonzero(fits & (score >= lo[who, j][:, None]) & (score <= hi[who, j][:, None]))
                found.append((who[i], np.full(len(i), j), score[i, c], ids[a:b][c]))
        kept = _best(*(np.concatenate(p) for p in zip(*found)), k)
        full = np.bincount(kept[0] * lo.shape[1] + kept[1], minlength=lo.size) >= k
        if full.any():  # a full window takes nothing below its k-th score any more
            worst = np.full(lo.size, np.inf)
            np.minimum.at(worst, kept[0] * lo.shape[1] + kept[1], kept[2].astype(np.float64))
            lo = np.where(full, np.maximum(lo.ravel(), worst), lo.ravel()).reshape(lo.shape)
        at, wave = at + wave, wave * 2
    return kept


# ------------------------------------------------------------------------ cells and trees on Spark
class Forest:
    """Cells (bounded, on the driver) and their written trees."""

    def __init__(self, cells: dict, trees: DataFrame, sphere: dict[int, float]):
        self.cells, self.trees, self.sphere = cells, trees, sphere


def _augmented(x: np.ndarray, sphere: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(sphere - np.square(x).sum(axis=1), 0.0))])


def _flat(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch):
    """(dim, rows) of a batch for each vector length in it."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def plant(rows: DataFrame, cell_rows: int = 4096, chunk_rows: int = 8192) -> Forest:
    """Deal ``rows(vec_id, label, dim, x)`` to cells and chunks, and write a cover tree of each chunk."""
    rows = rows.withColumn("bucket", F.pmod("label", F.lit(_BUCKETS)).cast("int"))
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    groups = rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m")).collect()
    sphere: dict[int, float] = {}
    for g in groups:
        sphere[g["dim"]] = max(sphere.get(g["dim"], 0.0), g["m"] + 1.0)
    each = max(cell_rows, -(-sum(g["n"] for g in groups) // _MAX_CELLS))
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(g["dim"], g["bucket"], -(-g["n"] // each)) for g in groups], "dim int, bucket int, _cells int")
    draw = Window.partitionBy("dim", "bucket").orderBy(F.xxhash64("vec_id", "label"), "vec_id", "x")
    sample = (rows.withColumn("_no", F.row_number().over(draw)).where(F.col("_no") <= _MAX_CELLS)
              .join(F.broadcast(wanted), ["dim", "bucket"]).where(F.col("_no") <= F.col("_cells")).collect())
    cells = [(r["dim"], r["bucket"], np.array(r["x"], np.float64)) for r in sample]
    of = {}
    for k, (dim, bucket, _) in enumerate(cells):
        of.setdefault((dim, bucket), []).append(k)
    of = {key: np.array(v) for key, v in of.items()}
    centre = {key: _augmented(np.array([cells[k][2] for k in v]).reshape(len(v), key[0]), sphere[key[0]]) for key, v in of.items()}

    def deal(batches):
        for batch in batches:
            for dim, part in _by_dim(batch):
                bucket = part.column("bucket").to_numpy(zero_copy_only=False)
                x = _augmented(_flat(part.column("x"), dim), sphere[dim])
                cell, away = np.zeros(len(x), np.int64), np.zeros(len(x))
                for b in np.unique(bucket).tolist():
                    at = np.flatnonzero(bucket == b)
                    c = centre[dim, b]
                    for s in range(0, len(at), 1024):
                        some = at[s:s + 1024]
                        near = (x[some] @ c.T).argmax(axis=1)  # all on one sphere
                        cell[some] = of[dim, b][near]
                        away[some] = np.sqrt(np.square(x[some] - c[near]).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("vec_id", "label", "dim", "x")), pa.array(cell.astype(np.int32)), pa.array(away)],
                                                 ["vec_id", "label", "dim", "x", "cell", "away"])

    dealt = stage(rows.select("vec_id", "label", "dim", "x", "bucket")
                  .mapInArrow(deal, "vec_id long, label long, dim int, x array<long>, cell int, away double"), "cover-dealt")
    held = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"),
                                                            F.min("label").alias("low"), F.max("label").alias("high")).collect()}
    table = {k: (cells[k][0], cells[k][2], held[k]["radius"], held[k]["low"], held[k]["high"], -(-held[k]["n"] // chunk_rows)) for k in held}
    chunks = spark.createDataFrame([(k, v[5]) for k, v in table.items()], "cell int, _chunks int")

    def grow(part: pa.Table) -> pa.Table:
        dim = part["dim"][0].as_py()
        x = _flat(part["x"].combine_chunks(), dim).astype(np.float64)
        t = build(_augmented(x, sphere[dim]))
        by = t["order"]
        lists = {"ids": part["vec_id"].to_numpy()[by], "labels": part["label"].to_numpy()[by], "x": x[by].ravel(),
                 "points": x[t["centre"]].ravel(), "radius": t["radius"] * (1 + 1e-9), "start": t["start"], "end": t["end"],
                 "parent": t["parent"], "level": t["level"], "leaf": t["leaf"].astype(np.int64)}
        return pa.table({"cell": part["cell"][:1], "chunk": part["chunk"][:1], "dim": part["dim"][:1],
                         **{n: pa.array([v.tolist()], pa.list_(pa.float64() if v.dtype.kind == "f" else pa.int64())) for n, v in lists.items()}})

    trees = (dealt.join(F.broadcast(chunks), "cell")
             .withColumn("chunk", F.pmod(F.xxhash64("vec_id", "x"), F.col("_chunks")).cast("int"))
             .select("cell", "chunk", "vec_id", "label", "dim", "x").groupBy("cell", "chunk")
             .applyInArrow(grow, "cell int, chunk int, dim int, ids array<long>, labels array<long>, x array<double>, points array<double>, "
                                 "radius array<double>, start array<long>, end array<long>, parent array<long>, level array<long>, leaf array<long>"))
    return Forest(table, stage(trees, "cover-trees"), sphere)


_QUERY = "qid long, label long, dim int, x array<long>, lo array<double>, hi array<double>, name array<long>"


def _windows(batch, column: str) -> np.ndarray:
    """A list column as a matrix; short rows end with windows that nothing fits (lo = inf, hi = -inf)."""
    lists = batch[column] if isinstance(batch, pa.Table) else batch.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lists), int(n.max(initial=1))), np.inf if column == "lo" else -np.inf)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def search(forest: Forest, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(qid, name, score, vec_id, rank): for each window [lo, hi] of ``queries(qid, label, dim, x, lo, hi, name)`` the first k
    candidates of the query's label (``same``) or of other labels with a score in it."""
    spark, sphere = queries.sparkSession, forest.sphere
    number = np.array(sorted(forest.cells), np.int64)
    by_dim = {dim: number[[forest.cells[c][0] == dim for c in number.tolist()]] for dim in sphere}
    centre = {dim: np.array([forest.cells[c][1] for c in v.tolist()]).reshape(len(v), dim) for dim, v in by_dim.items()}
    radius, low, high = ({dim: np.array([forest.cells[c][i] for c in v.tolist()]) for dim, v in by_dim.items()} for i in (2, 3, 4))
    chunks = spark.createDataFrame([(int(c), forest.cells[c][5]) for c in number.tolist()], "cell int, chunks int")

    def route(best: bool):
        def run(batches):
            for batch in batches:
                for dim, part in _by_dim(batch):
                    if dim not in by_dim:
                        continue
                    own = part.column("label").to_numpy(zero_copy_only=False)[:, None]
                    q, lo, hi = _flat(part.column("x"), dim).astype(np.float64), _windows(part, "lo"), _windows(part, "hi")
                    for s in range(0, len(q), 1024):
                        t = slice(s, s + 1024)
                        ip = product(q[t], centre[dim], sphere[dim]).astype(np.float64)
                        a, b = bounds(ip, np.sqrt(np.square(q[t]).sum(axis=1)), radius[dim] * (1 + 1e-9), sphere[dim])
                        fits = (own[t] >= low[dim]) & (own[t] <= high[dim]) if same else (own[t] != low[dim]) | (own[t] != high[dim])
                        fits &= reaches(a, b, lo[t], hi[t])
                        if best:  # the cell with the nearest centre
                            top = np.where(fits, ip, -np.inf).argmax(axis=1)
                            i, c = np.flatnonzero(fits.any(axis=1)), top[fits.any(axis=1)]
                        else:
                            done = _windows(part, "seen")[t, 0]
                            i, c = np.nonzero(fits & (by_dim[dim][None, :] != done[:, None]))
                        yield pa.RecordBatch.from_arrays([part.column("qid").take(pa.array(i + s)), pa.array(by_dim[dim][c].astype(np.int32))], ["qid", "cell"])
        return run

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            tree = {n: np.array(left[n][0].values.to_numpy(zero_copy_only=False)) for n in
                    ("ids", "labels", "x", "points", "radius", "start", "end", "parent", "level", "leaf")}
            x = tree["x"].reshape(-1, dim) if dim else np.zeros((len(tree["ids"]), 0))
            tree["points"] = tree["points"].reshape(-1, dim) if dim else np.zeros((len(tree["radius"]), 0))
            tree["centre"], tree["leaf"] = tree["radius"], tree["leaf"] > 0
            q = _flat(right["x"].combine_chunks(), dim).astype(np.float64)
            qi, w, s, ids = search_tree(tree, x, tree["ids"], tree["labels"], q, right["label"].to_numpy(), _windows(right, "lo"),
                                        _windows(right, "hi"), k, same, sphere[dim])
            names = right["name"].to_pylist()
            rows = [right["qid"].to_numpy()[qi], [names[a][b] for a, b in zip(qi.tolist(), w.tolist())], s.astype(np.int64), ids]
        rows = rows or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in rows], ["qid", "name", "score", "vec_id"])

    def visit(q: DataFrame, routed: DataFrame) -> DataFrame:
        routed = stage(routed, "cover-routes")
        load = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(_QUERIES)).cast("int").alias("blocks"))  # at most a row a cell
        plan = F.broadcast(load.join(chunks, "cell"))
        asked = (routed.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
                 .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
                 .select("qid", "cell", "chunk", "block").join(q.select("qid", "label", "x", "lo", "hi", "name"), "qid"))
        trees = forest.trees.join(plan.drop("chunks"), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        key = ["cell", "chunk", "block"]
        return trees.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, "qid long, name long, score long, vec_id long")

    def first(found: DataFrame) -> DataFrame:
        over = Window.partitionBy("qid", "name").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)

    nearest = stage(queries.mapInArrow(route(True), "qid long, cell int"), "cover-nearest")
    found = stage(first(visit(queries, nearest)), "cover-found")
    # a window with k rows needs nothing below its k-th score
    full = found.groupBy("qid", "name").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_worst")).where(F.col("_n") >= k)
    full = full.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("_worst").cast("double")))).alias("_worst"))
    raised = F.zip_with("lo", "name", lambda a, b: F.greatest(a, F.coalesce(F.try_element_at("_worst", b), a)))
    seen = nearest.select("qid", F.array(F.col("cell").cast("double")).alias("seen"))
    rest = (queries.join(full, "qid", "left").join(seen, "qid")
            .withColumn("lo", F.when(F.col("_worst").isNull(), F.col("lo")).otherwise(raised)).drop("_worst"))
    rest = stage(rest, "cover-rest")
    more = visit(rest, rest.mapInArrow(route(False), "qid long, cell int"))
    return first(found.drop("rank").unionByName(more))


def mine(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, relabel=None,
         factor: int = 256, cell_rows: int = 4096, chunk_rows: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchors`` holds:
    their first ``positives`` other rows of the same label, and for each the first ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` percent of the positive's. ``relabel`` replaces the label."""
    rows = scaled(vectors, factor)
    rows = stage((rows.withColumn("label", relabel.cast("long")) if relabel is not None else rows)
                 .withColumn("dim", F.size("x")).distinct(), "cover-rows")
    # an anchor's own rows are among its nearest: ask for as many more as rows share an id
    own_rows = rows.groupBy("vec_id", "label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    same_row = Window.partitionBy("label", "x").orderBy("vec_id")
    keep = max(positives + own_rows, negatives)
    forest = plant(rows.withColumn("_no", F.row_number().over(same_row)).where(F.col("_no") <= keep).drop("_no"), cell_rows, chunk_rows)
    asked = rows.where(anchors)
    distinct = stage(asked.groupBy("label", "dim", "x").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
                     .withColumn("qid", F.monotonically_increasing_id()), "cover-queries")
    each = stage(asked.select("vec_id", "label", "x").join(distinct.select("label", "x", "qid"), ["label", "x"])
                 .select(F.col("vec_id").alias("anchor_id"), "qid"), "cover-anchors")
    anywhere = distinct.withColumn("lo", F.array(F.lit(float("-inf")))).withColumn("hi", F.array(F.lit(float("inf")))).withColumn("name", F.array(F.lit(0).cast("long")))
    near = stage(search(forest, anywhere, positives + own_rows, True).select("qid", "score", F.col("vec_id").alias("positive_id")), "cover-positives")
    own = Window.partitionBy("anchor_id", "qid").orderBy(F.desc("score"), "positive_id")
    pairs = (each.join(near, "qid").where("positive_id != anchor_id").withColumn("_no", F.row_number().over(own)).where(F.col("_no") <= positives)
             .select("anchor_id", "qid", "positive_id", F.col("score").alias("positive_score")))
    # low * p <= 100 * s <= high * p in whole numbers
    spans = near.select("qid", "score", F.expr(f"({low} * score + pmod(-{low} * score, 100)) div 100").alias("lo"),
                        F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("hi")).where("lo <= hi").distinct()
    spans = spans.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "lo", "hi"))).alias("_w"))
    windows = distinct.join(spans, "qid").select("qid", "label", "dim", "x", F.col("_w.lo").cast("array<double>").alias("lo"),
                                                 F.col("_w.hi").cast("array<double>").alias("hi"), F.col("_w.score").alias("name"))
    hard = search(forest, stage(windows, "cover-windows"), negatives, False)
    return (pairs.join(hard.select("qid", F.col("name").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"),
                                   F.col("score").alias("negative_score")), ["qid", "positive_score"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
