"""Shared helpers of the text operators: bounded slices of Arrow batches, staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potentia.session import checkpoint_dir

SLICE_BYTES = 4 << 20


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    The files replace the plan that made them, so a lost executor costs one re-read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds at most ``max_bytes`` of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        i = 0
        while i < batch.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(i, j - i)
            i = j


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text"):
    """Lift a slice -> batch function to the iterator form ``mapInArrow`` takes."""
    def run(batches):
        for piece in slices(batches, text):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out
    return run


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null rows are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id falls in no fold (-1)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(folds), F.lit(-1))


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row-aware start positions of the runs outside [ \\t-\\r] in a text buffer."""
    solid = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    start[first] = solid[first]
    return np.flatnonzero(start)


def count_words(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words per row."""
    return np.diff(np.searchsorted(word_starts(raw, offsets), offsets)).astype(np.int64)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(2024).integers(0, (1 << 64) - 1, 256, dtype=np.uint64, endpoint=True)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word with A-Z lowered, words per row) of a text buffer."""
    start = word_starts(raw, offsets)
    per_row = np.diff(np.searchsorted(start, offsets)).astype(np.int64)
    if not len(start):
        return np.zeros(0, np.uint64), per_row
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    at = np.flatnonzero((raw != 0x20) & ((raw < 0x09) | (raw > 0x0D)))
    first = np.searchsorted(at, start)
    size = np.diff(np.append(first, len(at)))
    inside = np.arange(len(at)) - np.repeat(first, size)
    power = np.ones(int(size.max()), np.uint64)
    power[1:] = _BASE
    power = np.cumprod(power, dtype=np.uint64)
    return mixed(np.add.reduceat(_BYTE[low[at]] * power[inside], first)), per_row
