"""Embedding near-duplicates through spherical-cap filters.

A filter is a direction, and holds the vectors whose inner product with it exceeds a threshold
(a cap of the sphere). The directions form a random product code: the rotated space is cut into
two halves with ``width`` random unit codewords each, and every pair of codewords, one a half, is a
direction. A vector's inner product with a direction is the mean-scaled sum of its products
with the two codewords, so list decoding finds all exceeding directions of the width^2 from
2 x width products: sort the second half's, and for each codeword of the first take the head of
that list. The threshold lets ``filters`` directions through for a random vector.

Equal vectors of a label are one member with a number of copies. Members meet in the filters they
share (with equal labels), and a pair is verified by its cosine in double precision in the first
filter that both are in (a product of 0/1 matrices over the filters that a group's members
share tells which pairs met before), so links are counted without ever being listed: a filter returns
link counts and a spanning forest of its links. A filter with more than ``filter_rows`` members is cut into chunks, and each
pair of chunks is a task of its own.

Two vectors of cosine 0.93 both lie in about half of either one's filters, so with 24 filters
the chance to share none is below one in ten thousand; recall is measured against brute force in
the tests.

Defined results: null labels, null or zero vectors, vectors with null or non-finite components
and null vec_ids link with nothing and are their own component; vectors of different length do
not link; a row repeated as a whole is one vector (each copy gets its result); different vectors with
one vec_id are vectors of their own in one component, and their links add up; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potentia.llm.components import connected_components, unite
from potentia.llm.textio import stage
from potentia.llm.vectors import matrix, rotation, runs, usable

_CHUNK_PAIRS = 1 << 20
_MEMBERS = 64  # vectors in an average filter


class ProductCode:
    """Random product code over ``dim`` dimensions with ``width`` codewords in each half."""

    def __init__(self, dim: int, width: int, filters: float, seed: int = 9):
        self.width, self.half = width, dim // 2
        self.turn = rotation(dim, seed)
        rng = np.random.default_rng([seed, dim, width])

        def words(n: int) -> np.ndarray:
            w = rng.normal(size=(max(n, 1), width))
            return w / np.linalg.norm(w, axis=0)

        self.first, self.second = words(self.half), words(dim - self.half)
        if not self.half:  # one dimension: the second half is all
            self.first = np.zeros((1, width))
        # a random unit vector's product with a direction has variance 1 / dim
        share = min(0.5, filters / width ** 2)
        self.least = NormalDist().inv_cdf(1 - share) / np.sqrt(dim)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every direction each unit row exceeds; a row that exceeds none gets
        its best direction."""
        x = unit @ self.turn
        a = x[:, :self.half] @ self.first if self.half else np.zeros((len(x), self.width))
        b = x[:, self.half:] @ self.second
        order = np.argsort(-b, axis=1)
        ranked = np.take_along_axis(b, order, axis=1)
        need = self.least * np.sqrt(2.0) - a  # what the second half must add
        rows, filters = [], []
        live = np.ones(a.shape, bool)
        for k in range(self.width):  # the k-th best second codeword, until no row needs one more
            live &= ranked[:, k:k + 1] >= need
            i, c = np.nonzero(live)
            if not len(i):
                break
            rows.append(i)
            filters.append(c * self.width + order[i, k])
        row, found = (np.concatenate(rows), np.concatenate(filters)) if rows else (np.zeros(0, int), np.zeros(0, int))
        none = np.setdiff1d(np.arange(len(x)), row)
        return np.append(row, none), np.append(found, a[none].argmax(axis=1) * self.width + order[none, 0])


def _earlier(own: np.ndarray, here: int) -> np.ndarray:
    """0/1 matrix members x filters before ``here`` that at least two of the members are in."""
    row, col = np.nonzero((own >= 0) & (own < here))
    found, at, count = np.unique(own[row, col], return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    some = count[at] > 1
    out = np.zeros((len(own), int((count > 1).sum())), np.float32)
    out[row[some], place[at[some]]] = 1.0
    return out


def _verify(x: np.ndarray, copies: np.ndarray, own: np.ndarray, here: int, side: np.ndarray, a: int, b: int,
            cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links that count in this filter, flat parents of the links) of each member; members of
    chunk ``a`` meet those of chunk ``b``. A partner counts as often as it has ``copies``."""
    left = np.arange(len(x)) if a == b else np.flatnonzero(side == a)
    right = left if a == b else np.flatnonzero(side == b)
    before = _earlier(own, here)
    n, root = np.zeros(len(x), np.int64), np.arange(len(x))
    step = max(16, min(512, _CHUNK_PAIRS // max(1, len(right))))
    for k in range(0, len(left), step):
        some = left[k:k + step]
        other = right[k:] if a == b else right
        # a pair counts in the first filter that both are in: the others need no cosine
        new = before[some] @ before[other].T == 0 if before.shape[1] else np.ones((len(some), len(other)), bool)
        if a == b:
            new &= some[:, None] < other[None, :]
        rows, cols = np.flatnonzero(new.any(axis=1)), np.flatnonzero(new.any(axis=0))
        if not len(rows):
            continue
        if len(rows) < len(some) or len(cols) < len(other):
            some, other, new = some[rows], other[cols], new[np.ix_(rows, cols)]
        i, j = np.nonzero(new & (x[some] @ x[other].T >= cosine))
        i, j = some[i], other[j]
        n += np.bincount(i, copies[j], len(x)).astype(np.int64) + np.bincount(j, copies[i], len(x)).astype(np.int64)
        unite(root, i, j)
    return n, root


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(rep, label, embedding, dim, copies): the distinct usable vectors of each label, named by their smallest vec_id."""
    good = usable(vectors.select("vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL")).distinct()
    return good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))


def links(good: DataFrame, cosine: float = 0.93, filters: float = 24.0, filter_rows: int = 4096) -> DataFrame:
    """(vec_id, parent, n) rows from all filters over ``good(vec_id, label, dim, embedding, copies)``: partial
    link counts, and ``parent`` a linked vector's id (null: none), which make spanning forests."""
    # vectors meet within a label: the code's width follows the label's own rows, in powers of two
    sizes = good.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("_n"))
    width = F.greatest(F.lit(16.0), F.least(F.lit(float(1 << 14)), F.sqrt(F.col("_n") * filters / _MEMBERS)))
    sizes = sizes.select("label", "dim", F.pow(F.lit(2.0), F.ceil(F.log2(width) - 1e-9)).cast("int").alias("width"))
    good = good.join(sizes, ["label", "dim"])
    label = good.schema["label"].dataType.simpleString()
    ident = good.schema["vec_id"].dataType.simpleString()
    kind = good.schema["embedding"].dataType.simpleString()

    def decode(batches):
        codes: dict[tuple[int, int], ProductCode] = {}
        for batch in batches:
            dims, widths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "width"))
            for dim, wide in sorted(set(zip(dims.tolist(), widths.tolist()))):
                rows = batch.filter(pa.array((dims == dim) & (widths == wide)))
                if (dim, wide) not in codes:
                    codes[dim, wide] = ProductCode(dim, wide, filters)
                code = codes[dim, wide]
                for k in range(0, rows.num_rows, 2048):
                    some = rows.slice(k, 2048)
                    x = matrix(some.column("embedding"), dim)
                    row, found = code.decode(x / np.linalg.norm(x, axis=1, keepdims=True))
                    order = np.lexsort((found, row))
                    row, found = row[order], found[order]
                    ends = np.cumsum(np.bincount(row, minlength=some.num_rows))
                    own = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(found.astype(np.int32)))
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(c).take(at) for c in ("vec_id", "label", "embedding", "dim", "copies")] + [own.take(at), pa.array(found.astype(np.int32))],
                        ["vec_id", "label", "embedding", "dim", "copies", "own", "filter"])

    placed = good.mapInArrow(decode, f"vec_id {ident}, label {label}, embedding {kind}, dim int, copies long, own array<int>, filter int")
    crowded = (placed.groupBy("label", "dim", "filter").count().where(F.col("count") > filter_rows)
               .select(F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("filter").alias("_f"),
                       F.ceil(F.col("count") / filter_rows).cast("int").alias("_parts")))
    rows = (placed.join(crowded, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")) & (F.col("filter") == F.col("_f")), "left")
            .withColumn("_parts", F.coalesce("_parts", F.lit(1)))
            .withColumn("_own", F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("int")))
    # chunk c meets every other chunk once: the pair is named by its smaller and larger number
    rows = (rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
            .withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other"))
            .select("vec_id", "label", "dim", "filter", "own", "embedding", "copies", "_a", "_b", "_own"))

    key = ["label", "dim", "filter", "_a", "_b"]

    def meet(batches):
        for batch, cuts in runs(batches, key):
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            filters_, a, b, side, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("filter", "_a", "_b", "_own", "copies"))
            embedding, dims, own = batch.column("embedding"), batch.column("dim"), batch.column("own")
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if e - s < 2:
                    continue
                x = matrix(embedding.slice(s, e - s), dims[s].as_py())
                lists = own.slice(s, e - s)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                padded = np.full((e - s, sizes.max()), -1, np.int32)
                padded[np.arange(sizes.max()) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                n, root = _verify(x / np.linalg.norm(x, axis=1, keepdims=True), copies[s:e], padded, int(filters_[s]),
                                  side[s:e], int(a[s]), int(b[s]), cosine)
                out = np.flatnonzero((n > 0) | (root != np.arange(e - s)))
                if len(out):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[s:e][out]), pa.array(ids[s:e][root[out]], mask=root[out] == out), pa.array(n[out])],
                        ["vec_id", "parent", "n"])

    return (rows.repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(meet, f"vec_id {ident}, parent {ident}, n long"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, filters: float = 24.0, filter_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    good = stage(distinct_vectors(vectors), "cap-vectors")
    found = stage(links(good, cosine, filters, filter_rows), "cap-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("_n"))
    # each vector with the name of its equals
    rows = usable(vectors.select("vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL")).distinct()
    named = (rows.join(good.select("label", "dim", "embedding", F.col("vec_id").alias("_rep"), "copies"), ["label", "dim", "embedding"])
             .select(F.col("vec_id").alias("_v"), "_rep", "copies"))
    named = stage(named, "cap-names")
    # an id with several vectors joins their components
    several = named.groupBy("_v").agg(F.min("_rep").alias("_low"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    edges = (found.where("parent IS NOT NULL").select(F.col("vec_id").alias("u"), F.col("parent").alias("v"))
             .unionByName(named.join(several, "_v").select(F.col("_rep").alias("u"), F.col("_low").alias("v"))))
    comp = connected_components(edges)
    each = (named.join(counts.withColumnRenamed("vec_id", "_rep"), "_rep", "left")
            .join(comp, F.col("_rep") == F.col("node"), "left")
            .groupBy("_v").agg(F.sum(F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                               F.min(F.coalesce("component", "_rep")).alias("component")))
    component = F.coalesce(F.col("component"), F.col("vec_id"))
    return (vectors.select("vec_id").join(each, F.col("vec_id") == F.col("_v"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.col("vec_id").eqNullSafe(component).alias("kept")))
