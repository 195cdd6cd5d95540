"""Approximate nearest neighbours with an adaptive dimension scan.

Index: k-means lists, fitted on a bounded sample (``sample_rows`` vectors of smallest id hash, at
most ``sample_bytes``), into which every vector is put. A query probes its nearest lists.

Scan: inside a list the vectors lie rotated and in column blocks. A random rotation spreads a
difference evenly over the dimensions, so the distance over the first d of D dimensions,
scaled by D / d, estimates the whole; the hypothesis that a candidate is nearer than the
current k-th best is rejected, and the candidate abandoned, once that estimate exceeds the k-th
distance by the factor 1 + ``strictness`` / sqrt(d). Survivors are measured in double precision
on the original vectors.

Lists are cut into chunks of rows and the queries that probe a list into chunks of queries; each
pair of chunks is one group, so neither a hot list nor a hot query region fills a task. A
group returns at most k rows a query. The ``first`` nearest lists of a query are scanned before the
others, whose scans start from the k-th distance found there.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows
with a null vec_id, take no part; vectors of each length are indexed and searched on their own, one length
after another, so a candidate has the query's length; a row repeated as a whole counts once; rows of the query's own vec_id are not its
candidates; ties go to the smaller vec_id; a vec_id that asks at several lengths gets its k nearest over all of them; a query with fewer than k candidates returns them all; an
empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potentia.llm.textio import stage
from potentia.llm.vectors import matrix, rotation, usable

_SEGMENT = 1024  # rows between two updates of the k-th best


def _nearest(x: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centres of each row, nearest first."""
    d = (centres ** 2).sum(axis=1) - 2 * (x @ centres.T)
    if count < len(centres):
        some = np.argpartition(d, count - 1, axis=1)[:, :count]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable"), axis=1)
    return np.argsort(d, axis=1, kind="stable")


def _fit(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means centres of the sample; an empty list takes a random row again."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([_nearest(x[k:k + 4096], centres, 1)[:, 0] for k in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), lists)])
    return centres


def _scan(q: np.ndarray, turned: np.ndarray, ids: np.ndarray, x: np.ndarray, blocks: list[np.ndarray], own, known: float,
          k: int, strictness: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, squared distance) of the k nearest rows that the adaptive scan finds; ``known`` bounds
    the k-th squared distance from the lists scanned before."""
    rows, best, dim = np.zeros(0, np.int64), np.zeros(0), x.shape[1]
    for low in range(0, len(x), _SEGMENT):
        alive = np.arange(low, min(low + _SEGMENT, len(x)))
        alive = alive[ids[alive] != own]
        bound = min(known, best[k - 1] if len(best) >= k else np.inf)
        if bound == np.inf and len(alive) > 4 * k:  # a first k-th best from the segment's head
            head = ((x[alive[:4 * k]] - q) ** 2).sum(axis=1)
            bound = np.partition(head, k - 1)[k - 1]
        partial, done = np.zeros(len(alive)), 0
        for block in blocks:
            partial = partial + ((block[:, alive] - turned[done:done + len(block), None]) ** 2).sum(axis=0)
            done += len(block)
            if done < dim and bound < np.inf:
                keep = partial * (dim / done) <= (1 + strictness / np.sqrt(done)) ** 2 * bound
                alive, partial = alive[keep], partial[keep]
        exact = ((x[alive] - q) ** 2).sum(axis=1)
        rows, best = np.append(rows, alive), np.append(best, exact)
        order = np.lexsort((ids[rows], best))[:k]
        rows, best = rows[order], best[order]
    return rows, best


def search(vectors: DataFrame, queries: Column, k: int = 10, probe_share: float = 0.6, least_probes: int = 32, first: int = 2,
           max_lists: int = 4096, sample_rows: int = 20_000, sample_bytes: int = 64 << 20, strictness: float = 2.1,
           block: int = 16, chunk_rows: int = 8192, chunk_queries: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``queries`` selects,
    by Euclidean distance."""
    ident = vectors.schema["vec_id"].dataType.simpleString()
    kind = vectors.schema["embedding"].dataType.simpleString()
    good = usable(vectors.where("vec_id IS NOT NULL").select("vec_id", "embedding", queries.alias("_query")))
    dims = good.groupBy("dim").agg(F.count(F.lit(1)).alias("count"), F.max("_query").alias("asked")).orderBy(F.desc("count"), "dim").collect()
    found = [_search(good.where(F.col("dim") == r["dim"]).select("vec_id", "embedding", "_query"), r["dim"], r["count"], k, probe_share,
                     least_probes, first, max_lists, sample_rows, sample_bytes, strictness, block, chunk_rows, chunk_queries)
             for r in dims if r["asked"]]
    if not found:
        return vectors.sparkSession.createDataFrame([], f"query_id {ident}, rank int, vec_id {ident}, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _best(out, k).select("query_id", "rank", "vec_id", "score") if len(found) > 1 else out


def _best(near: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.select("query_id", "vec_id", "score").distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def _search(good: DataFrame, dim: int, n: int, k: int, probe_share: float, least_probes: int, first: int, max_lists: int, sample_rows: int,
            sample_bytes: int, strictness: float, block: int, chunk_rows: int, chunk_queries: int) -> DataFrame:
    """``search`` over the ``n`` vectors of one length."""
    ident = good.schema["vec_id"].dataType.simpleString()
    kind = good.schema["embedding"].dataType.simpleString()
    most = max(1, min(sample_rows, sample_bytes // (8 * dim)))
    sample = good.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
    turn = rotation(dim, 8)
    x = np.array([r["embedding"] for r in sample], np.float64)
    lists = int(max(1, min(max_lists, np.sqrt(n), len(x) // 8)))
    centres = _fit(x, lists)
    probes = int(min(lists, max(least_probes, np.ceil(probe_share * lists))))

    def assign(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                some = batch.slice(s, 4096)
                own = _nearest(matrix(some.column("embedding"), dim), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in ("vec_id", "embedding", "_query")],
                                                  pa.array(own.astype(np.int32))], ["vec_id", "embedding", "_query", "list"])

    placed = stage(good.mapInArrow(assign, f"vec_id {ident}, embedding {kind}, _query boolean, list int"), "ann-index")
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # one row a list
    size = np.array([sizes.get(i, 0) for i in range(lists)])

    def probe(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                some = batch.slice(s, 1024)
                order = _nearest(matrix(some.column("embedding"), dim), centres, lists)
                # further lists where the nearest ones hold too few candidates
                before = np.cumsum(size[order], axis=1) - size[order]
                row, at = np.nonzero((np.arange(lists) < probes) | (before <= k))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([some.column("vec_id").take(take), some.column("embedding").take(take),
                                                  pa.array(order[row, at].astype(np.int32)), pa.array(at.astype(np.int32))],
                                                 ["query_id", "query", "list", "place"])

    asked = placed.where("_query").select("vec_id", "embedding").mapInArrow(
        probe, f"query_id {ident}, query {kind}, list int, place int")
    asked = stage(asked, "ann-probes")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        id_type = left.schema.field("vec_id").type
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("vec_id").combine_chunks(), right.combine_chunks()
            ids, x = left.column("vec_id").to_numpy(), matrix(left.column("embedding").combine_chunks(), dim)
            new = np.append(True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1))
            ids, x = ids[new], x[new]
            turned = x @ turn
            blocks = [np.ascontiguousarray(turned[:, s:s + block].T) for s in range(0, dim, block)]
            qs, qids = matrix(right.column("query").combine_chunks(), dim), right.column("query_id").to_numpy()
            known = right.column("bound").to_numpy()
            for q, t, own, r in zip(qs, qs @ turn, qids, known):
                rows, d2 = _scan(q, t, ids, x, blocks, own, r, k, strictness)
                found.append((np.full(len(rows), own), ids[rows], np.sqrt(d2)))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pa.Table.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], id_type), pa.array(cols[2], pa.float64())],
                                    names=["query_id", "vec_id", "score"])

    def scanned(asked: DataFrame) -> DataFrame:
        counts = (placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_rows"))
                  .join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / chunk_queries).cast("int").alias("_asks")), "list")
                  .withColumnRenamed("list", "_list"))

        def chunked(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
            return (df.join(counts, F.col("list") == F.col("_list"))
                    .withColumn("_mine", F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
                    .withColumn("_theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1))))

        members = (chunked(placed, "vec_id", "_rows", "_asks")
                   .select("list", F.col("_mine").alias("a"), F.col("_theirs").alias("b"), "vec_id", "embedding"))
        askers = (chunked(asked, "query_id", "_asks", "_rows")
                  .select("list", F.col("_theirs").alias("a"), F.col("_mine").alias("b"), "query_id", "query", "bound"))
        near = members.groupBy("list", "a", "b").cogroup(askers.groupBy("list", "a", "b")).applyInArrow(
            meet, f"query_id {ident}, vec_id {ident}, score double")
        return stage(near, "ann-near")

    start = scanned(asked.where(F.col("place") < first).withColumn("bound", F.lit(float("inf"))))
    bounds = (_best(start, k).where(F.col("rank") == k)
              # a little above the k-th distance, so that rounding loses no tie
              .select(F.col("query_id").alias("_id"), (F.col("score") * F.col("score") * (1 + 1e-9)).alias("_bound")))
    rest = (asked.where(F.col("place") >= first).join(bounds, F.col("query_id") == F.col("_id"), "left")
            .withColumn("bound", F.coalesce("_bound", F.lit(float("inf")))))
    return _best(start.unionByName(scanned(rest)), k).select("query_id", "rank", "vec_id", "score")
