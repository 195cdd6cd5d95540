"""Shared helpers of the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls, all of ``dim`` numbers, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null, not zero and holds finite numbers only, with its length
    ``dim``; other columns stay."""
    v = vectors
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return v.where(F.col("embedding").isNotNull() & ~bad & some).withColumn("dim", F.size("embedding"))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def runs(batches, keys: list[str]):
    """Whole runs of rows with equal ``keys`` from batches sorted by them, many runs a batch:
    (batch, run bounds). A run that crosses batches is joined; memory is one batch and one run."""
    held: list[pa.RecordBatch] = []

    def bounds(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(new), batch.num_rows)

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = bounds(batch)
        if held and any(held[0].column(k)[0] != batch.column(k)[0] for k in keys):
            whole = joined(held)
            yield whole, np.array([0, whole.num_rows])
            held = []
        if len(cuts) == 2:  # one run so far
            held.append(batch)
            continue
        start = 0
        if held:
            whole = joined([*held, batch.slice(0, cuts[1])])
            yield whole, np.array([0, whole.num_rows])
            start, held = 1, []
        if len(cuts) - 2 > start:
            done = batch.slice(cuts[start], cuts[-2] - cuts[start])
            yield done, cuts[start:-1] - cuts[start]
        held = [batch.slice(cuts[-2])]
    if held:
        whole = joined(held)
        yield whole, np.array([0, whole.num_rows])
