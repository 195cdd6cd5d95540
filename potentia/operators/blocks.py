"""A graph and the vectors on its nodes as numpy blocks in an RDD (V1, V2).

An iterative solve takes dozens of sweeps over the same edges, so what a sweep costs besides its arithmetic
decides. Nodes are dealt to parts by the hash of their key. A part's record holds the columns of
its nodes, one number a node and problem, and another record the edges that start their way there, sorted by the
part and node they lead to. A sweep is then one job of two stages without a plan of its own:

1. where the vector lies, every edge's product is summed by the node it goes to;
2. the sums, one row a node and sending part, are shuffled to their parts and added there.

The number of parts follows the size, so that a part stays some tens of MB, and is no larger than that and the cores ask
for: the fewer parts, the more of a node's edges are summed before they are sent. Only what ``totals`` returns reaches the driver.

On disk a solve holds one sweep: the files of its exchange go when its sums are in the rows, a checkpoint goes when the
next one is written, and ``release`` leaves none.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potentia.session import checkpoint_dir, collect_garbage, cut_lineage, delete_checkpoint, drop_cut, drop_shuffle, ship_package

#: Edges x problems of a part: at least, and at most where there are parts for all cores.
PART_SIZE, MOST_SIZE = 1 << 19, 1 << 22
#: Parts a core, where parts are small.
CORE_PARTS = 4
#: Sweeps between two checkpoints.
CHECKPOINT_EVERY = 12
_UNPACKED = 1 << 16  # rows of a batch on the way out


def _find(rows: dict, ids: np.ndarray, q: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of the keys among a part's rows."""
    if not len(rows["ids"]):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    at = np.minimum(np.searchsorted(rows["names"], ids), len(rows["names"]) - 1)
    found = rows["names"][at] == ids
    if q is None:
        return at, found
    key = at * rows["problems"] + q
    at = np.minimum(np.searchsorted(rows["keys"], key), len(rows["keys"]) - 1)
    return at, found & (rows["keys"][at] == key)


def _empty(problems: int, own: bool, columns: list[str]) -> tuple[dict, dict]:
    width = 1 if own else problems
    rows = {"ids": np.zeros(0, np.int64), "names": np.zeros(0, np.int64), "keys": np.zeros(0, np.int64), "problems": problems,
            "q": np.zeros((0, width), np.int64), "has": np.zeros((0, width), bool), "many": np.zeros((0, width)),
            "z": np.zeros(0, np.int64), **{c: np.zeros((0, width)) for c in columns}}
    return rows, {"ids": np.zeros(0, np.int64)}


def _pack_rows(pdf: pd.DataFrame, problems: int, own: bool, columns: list[str]) -> dict:
    """Rows (_q, id, columns, _z) as matrices: a row a node and a column a problem, or, where each problem has
    edges of its own, a row a node and problem."""
    ids, q = pdf["id"].to_numpy(np.int64), pdf["_q"].to_numpy(np.int64)
    names, at = np.unique(ids, return_inverse=True)
    if own:
        keys, at = np.unique(at * problems + q, return_inverse=True)
        shape, cell = (len(keys), 1), (at, np.zeros_like(at))
        row_ids, row_q = names[keys // problems], (keys % problems)[:, None]
    else:
        keys, shape, cell = np.zeros(0, np.int64), (len(names), problems), (at, q)
        row_ids, row_q = names, np.broadcast_to(np.arange(problems), shape).copy()
    many = np.zeros(shape)
    np.add.at(many, cell, 1.0)
    out = {"ids": row_ids, "names": names, "keys": keys, "problems": problems, "q": row_q, "has": many > 0, "many": many}
    for c in columns:  # of a key that comes twice, the largest, as SQL's max takes it
        values = np.full(shape, -np.inf)
        np.fmax.at(values, cell, pdf[c].to_numpy(np.float64))
        out[c] = np.where(np.isneginf(values), np.where(out["has"], np.nan, 0.0), values)
    out["z"] = np.full(shape[0], -1, np.int64)
    np.maximum.at(out["z"], at, pdf["_z"].to_numpy(np.int64))
    return out


def _pack_edges(pdf: pd.DataFrame, rows: dict, own: bool) -> dict:
    """Edges whose ``dst`` lies here, sorted by the part and key of ``src``; those from keys without a row are left out."""
    q = pdf["_q"].to_numpy(np.int64) if own else None
    at, found = _find(rows, pdf["dst"].to_numpy(np.int64), q)
    to, src, w = pdf["_to"].to_numpy(np.int64)[found], pdf["src"].to_numpy(np.int64)[found], pdf["w"].to_numpy(np.float64)[found]
    q, at = q[found] if own else np.zeros(len(to), np.int64), at[found]
    if not len(to):
        return {"ids": np.zeros(0, np.int64)}
    order = np.lexsort((at, q, src, to))
    to, src, q, at, w = to[order], src[order], q[order], at[order], w[order]
    starts = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (src[1:] != src[:-1]) | (q[1:] != q[:-1])]))
    parts, bounds = np.unique(to[starts], return_index=True)
    return {"ids": src[starts], "q": q[starts] if own else None, "starts": starts, "at": at, "w": w,
            "parts": parts, "bounds": np.append(bounds, len(starts))}


def _send(pair: tuple[dict, dict], column: str, active: np.ndarray, first: bool):
    """(part, (ids, problems or None, sums)): what the edges bring to each part."""
    edges, rows = pair
    if not len(edges["ids"]):
        return
    u = rows[column] * rows["many"] if first else rows[column]
    if edges["q"] is None:
        u = u[:, active]
    else:
        u = np.where(active[rows["q"]], u, 0.0)
    sums = np.add.reduceat(edges["w"][:, None] * u[edges["at"]], edges["starts"], axis=0)
    for part, a, b in zip(edges["parts"], edges["bounds"][:-1], edges["bounds"][1:]):
        yield int(part), (edges["ids"][a:b], None if edges["q"] is None else edges["q"][a:b], sums[a:b])


def _add(pair: tuple[dict, list], column: str, active: np.ndarray) -> tuple[dict, np.ndarray]:
    """The rows and the sums that came for them, 0 where none did."""
    rows, parcels = pair
    total = np.zeros(rows[column].shape)
    for ids, q, sums in parcels:
        at, found = _find(rows, ids, q)
        if q is None:
            total[np.ix_(at[found], np.flatnonzero(active))] += sums[found]  # a parcel names a node once
        else:
            total[at[found]] += sums[found]
    return rows, total


def _unpack(batches, column: str):
    for pdf in batches:
        for packed in pdf["rows"]:
            rows = pickle.loads(packed)
            i, j = np.nonzero(rows["has"])
            for a in range(0, len(i), _UNPACKED):
                x, y = i[a:a + _UNPACKED], j[a:a + _UNPACKED]
                yield pd.DataFrame({"_q": rows["q"][x, y].astype(np.int32), "id": rows["ids"][x], "v": rows[column][x, y]})


class Blocks:
    """``edges(src, dst, w)``, or with a ``problem_id`` each problem's own, and ``rows(problem_id, id, _q, columns)``
    with ``_q`` the problem's place in ``pids``; a whole number ``_z`` of a node may come along. Rows without an id
    have no edge and are left to the caller; a row that comes twice counts twice in the first sweep and once after it,
    or with ``always`` twice in each."""

    def __init__(self, edges: DataFrame, rows: DataFrame, pids: list, columns: list[str], n: int, *, always: bool = False):
        self.spark = edges.sparkSession
        ship_package(self.spark)
        checkpoint_dir(self.spark)
        own = "problem_id" in edges.columns
        self.always, problems = always, max(1, len(pids))
        size = edges.count() * (1 if own else problems)
        size, cores = max(size, n * problems), self.spark.sparkContext.defaultParallelism
        self.parts = max(1, -(-size // MOST_SIZE), min(-(-size // PART_SIZE), CORE_PARTS * cores))
        self.sweeps, self.problems, self.written = 0, problems, None
        keys = ["problem_id"] if own else []
        edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("w").isNotNull())
        if own:
            edges = edges.withColumn("_q", place(pids)).where("_q >= 0")
        edges = edges.select(self._part("dst", keys).alias("_part"), self._part("src", keys).alias("_to"),
                             F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w", *(["_q"] if own else []))
        rows = rows.where(F.col("id").isNotNull()).select(
            self._part("id", keys).alias("_part"), "_q", F.col("id").cast("long").alias("id"),
            (F.col("_z") if "_z" in rows.columns else F.lit(-1)).alias("_z"), *[F.col(c).cast("double").alias(c) for c in columns])

        def build(key, mine, theirs):
            packed = _pack_rows(mine, problems, own, columns)
            return pd.DataFrame({"part": [key[0]], "rows": [pickle.dumps(packed)], "edges": [pickle.dumps(_pack_edges(theirs, packed, own))]})

        packed = self.packed = cut_lineage(rows.groupBy("_part").cogroup(edges.groupBy("_part")).applyInPandas(
            build, "part int, rows binary, edges binary"))
        nothing = _empty(problems, own, columns)

        def one(found):
            yield next(((pickle.loads(r), pickle.loads(e)) for _, (r, e) in found), nothing)

        self.shuffled = packed.rdd.map(lambda r: (r["part"], (bytes(r["rows"]), bytes(r["edges"])))).partitionBy(self.parts, int)
        both = self.shuffled.mapPartitions(one)
        self.edges = both.map(lambda x: x[1]).persist(StorageLevel.MEMORY_AND_DISK)
        self.rows = both.map(lambda x: x[0]).persist(StorageLevel.MEMORY_AND_DISK)
        collect_garbage(self.spark)

    def _part(self, column: str, keys: list[str]) -> Column:
        key = F.xxhash64(F.col(column).cast("long"), *[F.col(k).cast("long") for k in keys])
        return F.pmod(key, F.lit(self.parts)).cast("int")

    def totals(self, fn) -> list:
        """``fn(rows)`` of every part."""
        return self.rows.map(fn).collect()

    def advance(self, before, column: str, active: np.ndarray, after, totals) -> list:
        """One sweep: rows become ``before(rows)`` (if any), then ``after(rows, W rows[column])``, the product being 0 in
        the problems that are not ``active``. Returns ``totals(rows)`` of every part, from the same job."""
        old, first, self.sweeps = self.rows, self.always or self.sweeps == 0, self.sweeps + 1
        half = old.map(before).persist(StorageLevel.MEMORY_AND_DISK) if before else old
        shuffled = self.edges.zip(half).flatMap(partial(_send, column=column, active=active, first=first)).partitionBy(self.parts, int)
        sent = shuffled.mapPartitions(lambda it: [[parcel for _, parcel in it]])
        self.rows = half.zip(sent).map(lambda pair: after(*_add(pair, column, active))).persist(StorageLevel.MEMORY_AND_DISK)
        if self.sweeps % CHECKPOINT_EVERY == 0:
            self.rows.checkpoint()
        out = self.totals(totals)
        old.unpersist()
        half.unpersist()
        for done in (shuffled, self.shuffled):  # the second after the first sweep, which kept edges and rows
            if done is not None:
                drop_shuffle(done)
        self.shuffled = None
        if self.rows.isCheckpointed():
            before, self.written = self.written, self.rows.getCheckpointFile()
            delete_checkpoint(self.spark, before)
        return out

    def table(self, column: str) -> DataFrame:
        """``_q, id, v``: the column's values, a row a key."""
        packed = self.rows.map(lambda rows: (pickle.dumps({k: rows[k] for k in ("ids", "q", "has", column)}),))
        return self.spark.createDataFrame(packed, "rows binary").mapInPandas(partial(_unpack, column=column), "_q int, id long, v double")

    def release(self) -> None:
        """Free what the solve held; what was made of ``table`` must have been written."""
        self.edges.unpersist()
        self.rows.unpersist()
        delete_checkpoint(self.spark, self.written)
        drop_cut(self.packed)
        self.written = self.packed = self.rows = self.edges = None
        collect_garbage(self.spark)


def place(pids: list[int]) -> Column:
    """The problem's place in ``pids`` as a column, by an array position."""
    return (F.array_position(F.array(*[F.lit(int(p)).cast("long") for p in pids]), F.col("problem_id").cast("long")) - 1).cast("int").alias("_q")
