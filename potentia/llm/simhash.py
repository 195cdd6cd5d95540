"""SimHash near-duplicates through vantage-point trees over Hamming distance.

Fingerprints of unrelated texts lie about 32 bits apart, where a radius of 4 prunes little of
a tree over all 64 bits. The bits are therefore cut into blocks; two fingerprints within
``max_bits`` differ by at most ``max_bits // blocks`` in one block (one bit in 21 or 22 by
default), and a vantage-point forest has one tree per block, over the Hamming distance of
that block's bits. In such a tree the triangle bound prunes two thirds at each level.

Distinct fingerprints alone enter the search (copies share one). The upper levels of each tree
cut it into shards: a fingerprint belongs to the shard on its side of every vantage point's
median distance and visits the shards across each boundary that it is within the radius of.
Inside a shard the tree goes on to small leaves, whose pairs are verified on all 64 bits, so
the pairs are exact. A shard returns a spanning forest of its links, never its pairs; the
components of all forests together are those of all links. A shard with more members than
``shard_rows`` is split by members, its visitors going to every split.

Defined results: a null or empty text, or one of white space, has fingerprint zero, linked as
any other; repeated rows share a fingerprint; component ids ignore null doc_ids (a group of null
ids alone has a null id); an empty table gives an empty one; extra columns are ignored
(``deduplicate`` passes them on).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potentia.llm.components import connected_components, unite
from potentia.llm.textio import per_slice, stage

_LEAF_PAIRS = 1 << 17
_MAX_DEPTH = 40


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of the text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(shingle, len(words)) - 1:].tolist()
    starts = np.append(0, ends[:-1] + 1)[:len(last)].tolist()
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(last), 1 << 16):
        hashes = np.array([h(line[a:b], seed) for a, b in zip(starts[k:k + (1 << 16)], last[k:k + (1 << 16)])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint as a signed long) of every row."""
    src = docs.select(*dict.fromkeys([*keep, "text"]))

    def one(piece):
        fps = np.array([fingerprint(t, shingle) for t in piece.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], pa.array(fps)], [*keep, "fp"])

    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(per_slice(one), f"{kinds}, fp long")


class _Tree:
    """One block's vantage points, the same for all nodes of a level: bit patterns drawn from the
    level's number, with the median of a random fingerprint's distance as the boundary."""

    def __init__(self, block: int, blocks: int):
        low, high = 64 * block // blocks, 64 * (block + 1) // blocks
        self.mask = np.uint64(((1 << (high - low)) - 1) << low)
        self.inner = (high - low - 1) // 2  # d <= inner is one side, d > inner the other
        rng = np.random.default_rng([block, blocks])
        self.points = rng.integers(0, (1 << 64) - 1, _MAX_DEPTH, dtype=np.uint64, endpoint=True) & self.mask

    def distance(self, fp: np.ndarray, level: int) -> np.ndarray:
        return np.bitwise_count((fp & self.mask) ^ self.points[level]).astype(np.int16)


def _routes(fp: np.ndarray, tree: _Tree, levels: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of every shard each fingerprint belongs to or visits."""
    row, shard, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
    for level in range(levels):
        d = tree.distance(fp, level)[row]
        side = (d > tree.inner).astype(np.int64)
        # across the boundary only points at inner + 1 and beyond (or inner and below) lie
        near = np.where(side == 1, d - tree.inner, tree.inner + 1 - d) <= radius
        row, home = np.append(row, row[near]), np.append(home, np.zeros(near.sum(), bool))
        shard = np.append(shard * 2 + side, shard[near] * 2 + 1 - side[near])
    return row, shard, home


def _search(fp: np.ndarray, home: np.ndarray, tree: _Tree, level: int, radius: int, max_bits: int) -> np.ndarray:
    """Flat parents over ``fp`` after uniting every pair (home, any) within ``max_bits``."""
    root = np.arange(len(fp))
    todo = [(np.flatnonzero(home), np.arange(len(fp)), level)]
    while todo:
        own, near, at = todo.pop()
        if not len(own):
            continue
        if len(own) * len(near) <= _LEAF_PAIRS or at == _MAX_DEPTH:
            step = max(1, _LEAF_PAIRS // len(near))
            for k in range(0, len(own), step):
                some = own[k:k + step]
                i, j = np.nonzero(np.bitwise_count(fp[some][:, None] ^ fp[near][None, :]) <= max_bits)
                unite(root, some[i], near[j])
            continue
        d_own, d_near = tree.distance(fp[own], at), tree.distance(fp[near], at)
        todo.append((own[d_own <= tree.inner], near[d_near <= tree.inner + radius], at + 1))
        todo.append((own[d_own > tree.inner], near[d_near > tree.inner - radius], at + 1))
    return root


def links(fps: DataFrame, max_bits: int = 4, blocks: int = 3, shard_rows: int = 1 << 14) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of ``fps(fp)`` within ``max_bits``.

    ``fps`` holds distinct fingerprints and is read three times."""
    n = fps.count()
    levels = max(0, min(_MAX_DEPTH // 2, math.ceil(math.log2(max(1, n) / shard_rows))))
    radius = max_bits // blocks

    def route(batches):
        trees = [_Tree(b, blocks) for b in range(blocks)]
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for b, tree in enumerate(trees):
                for k in range(0, len(fp), 1 << 12):
                    row, shard, home = _routes(fp[k:k + (1 << 12)], tree, levels, radius)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard * blocks + b), pa.array(home), pa.array(fp[k:k + (1 << 12)][row].view(np.int64))],
                        ["shard", "home", "fp"])

    routed = fps.select("fp").mapInArrow(route, "shard long, home boolean, fp long")
    crowded = (routed.where("home").groupBy("shard").count().where(F.col("count") > 2 * shard_rows)
               .select(F.col("shard").alias("_s"), F.ceil(F.col("count") / shard_rows).alias("_splits")))
    split = routed.join(crowded, F.col("shard") == F.col("_s"), "left").withColumn("_splits", F.coalesce("_splits", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("_splits"))
    rows = (split.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_splits").cast("long") - 1)))
            .select("shard", "part", (F.col("home") & (own == F.col("part"))).alias("home"), "fp"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, home = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy(bool)
        root = _search(fp, home, _Tree(int(pdf["shard"].iloc[0]) % blocks, blocks), levels, radius, max_bits)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"u": fp[moved].view(np.int64), "v": fp[root[moved]].view(np.int64)})

    return rows.groupBy("shard", "part").applyInPandas(meet, "u long, v long")


def groups(marked: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, group), staged: each distinct fingerprint of ``marked(fp)`` with the fingerprint that names
    its component."""
    distinct = stage(marked.select("fp").distinct(), "simhash-distinct")
    comp = connected_components(links(distinct, max_bits)).withColumnRenamed("node", "_node")
    named = distinct.join(comp, F.col("fp") == F.col("_node"), "left")
    return stage(named.select("fp", F.coalesce("component", "fp").alias("group")), "simhash-groups")


def classes(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): one row per document, the class named by its smallest doc_id."""
    marked = stage(fingerprints(docs, shingle), "simhash-fp")
    found = groups(marked, max_bits)
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(found, "fp")
    # both joins read staged tables, whose shuffles Spark can split where a group is large
    least = stage(first.groupBy("group").agg(F.min("doc_id").alias("component_id")), "simhash-least")
    named = stage(found.join(least, "group").select(F.col("fp").alias("_fp"), "component_id"), "simhash-classes")
    return marked.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each group, with all columns: the smallest doc_id (null last), then the smallest
    hash of the whole row."""
    named = docs.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    marked = stage(fingerprints(named, shingle, ("doc_id", "__row")), "simhash-fp")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    first = (marked.groupBy("fp").agg(least.alias("k")).join(groups(marked, max_bits), "fp")
             .groupBy("group").agg(F.min("k").alias("k")))
    kept = first.select(F.col("k.doc_id").alias("_id"), F.col("k.__row").alias("_r")).distinct()
    # copies of one whole row meet here under one key
    return (named.join(kept, (F.col("__row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
            .dropDuplicates(["__row", "doc_id"]).select(*docs.columns))
