"""The generators (S12-S20) as a Spark data source, for batch reads and streams.

    register(spark)
    spark.read.format("potentia_points").option("shape", "spiral").option("rows", 10**9).load()
    spark.readStream.format("potentia_points").option("shape", "line").option("rows", 10**6).load()

Row ``id`` of ``0..rows-1`` has the point that the column expression of :mod:`potentia.sources.generators` gives for
the same id and ``seed``, so splits, batches and restarts do not change a value and no table of
ids is read. A split makes Arrow batches of ``BATCH`` rows; nothing is held beyond one.

Options: ``shape``; ``rows``; ``seed`` (0); ``partitions`` (default: one a million rows); ``params``, a JSON
object with the generator's arguments (``cluster_centers``' arguments for ``clusters``). Filters ``id`` above, below
or equal to a number leave out whole ranges. A stream offers all rows at once, or, with ``rowsPerSecond``
and ``since`` (seconds of the epoch), the first ``(now - since) * rowsPerSecond`` of them: offsets
depend on the clock and the options alone, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual)

from potentia.sources.generators import cluster_centers

NAME = "potentia_points"
BATCH = 8192


class _Draws:
    """Uniforms and normals of a block of ids, as ``functions.rand`` defines them."""

    def __init__(self, ids: range, seed):
        self.keys, self.seed = [str(i).encode() for i in ids], seed

    def uniform(self, name: str) -> np.ndarray:
        tail = f":{self.seed}:{name}".encode()
        return np.array([int(hashlib.md5(k + tail).hexdigest()[:13], 16) for k in self.keys], dtype=float) / float(1 << 52)

    def normal(self, name: str) -> np.ndarray:
        return np.sqrt(-2.0 * np.log(1.0 - self.uniform(f"{name}:a"))) * np.cos(2.0 * math.pi * self.uniform(f"{name}:b"))


def _line(ids, draw, start=0.0, end=1.0):
    return [draw.uniform("u") * (end - start) + start]


def _square_edge(ids, draw, p1=(0.0, 0.0), p2=(1.0, 1.0)):
    quarter = draw.uniform("u") * 4.0
    side = np.floor(quarter)
    x, y = (a + (quarter - side) * (b - a) for a, b in zip(p1, p2))
    return [np.select([side == 0, side == 2], [p1[0], p2[0]], x), np.select([side == 1, side == 3], [p2[1], p1[1]], y)]


def _square_fill(ids, draw, p1=(0.0, 0.0), p2=(1.0, 1.0)):
    return [(b - a) * draw.uniform(n) + a for a, b, n in zip(p1, p2, "xy")]


def _eighth_sphere(ids, draw, radius=1.0, x_pos=1, y_pos=1, z_pos=1):
    height, azimuth = draw.uniform("z"), draw.uniform("a") * (math.pi / 2)
    ring = np.sqrt(1.0 - height * height)
    return [(radius if s else -radius) * c for s, c in zip((x_pos, y_pos, z_pos), (ring * np.cos(azimuth), ring * np.sin(azimuth), height))]


def _triangle(ids, draw, vertices):
    u, v = draw.uniform("1"), draw.uniform("2")
    over = u + v > 1.0
    second, third = np.where(over, 1.0 - u, u), np.where(over, 1.0 - v, v)
    return [(1.0 - second - third) * a + second * b + third * c for a, b, c in zip(*vertices)]


def _clusters(ids, draw, mean, external_std, clusters, internal_std, centers_seed=0):
    centers = np.array(cluster_centers(mean, external_std, clusters, centers_seed))
    which = np.minimum(np.floor(draw.uniform("c") * clusters), clusters - 1).astype(int)
    return [centers[which, i] + internal_std * draw.normal(f"n{i}") for i in range(centers.shape[1])]


def _spiral(ids, draw, radius=1.0, rotations=3, height=1.0):
    total = 2 * math.pi * rotations
    turn = draw.uniform("d") * total
    return [radius * np.cos(turn), radius * np.sin(turn), height / total * turn]


def _grid_1d(ids, draw, n):
    return [np.arange(ids.start, ids.stop, dtype=float) / n]


#: Shape -> the coordinates of a block of ids; ``SHAPES[name] = f`` before a read adds one.
SHAPES: dict[str, Callable[..., list[np.ndarray]]] = {
    "line": _line, "square_edge": _square_edge, "square_fill": _square_fill, "eighth_sphere": _eighth_sphere,
    "triangle": _triangle, "clusters": _clusters, "spiral": _spiral, "grid_1d": _grid_1d}


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))


class _Points:
    """What the batch and the stream reader share: options, splits and rows."""

    def __init__(self, options: dict):
        self.rows, self.seed = int(options["rows"]), options.get("seed", "0")
        if self.rows < 0:
            raise ValueError("rows must not be negative")
        self.shape = options.get("shape", "")
        if self.shape not in SHAPES:
            raise ValueError(f"unknown shape {self.shape!r}; there are {sorted(SHAPES)}")
        self.make, self.params = SHAPES[self.shape], json.loads(options.get("params", "{}"))
        if self.shape == "grid_1d":
            self.params.setdefault("n", self.rows)
        self.parts = int(options.get("partitions", 0))

    def split(self, start: int, stop: int) -> list[_Range]:
        n = stop - start
        if n <= 0:
            return []
        parts = min(n, self.parts or -(-n // 1_000_000))
        cuts = [start + n * i // parts for i in range(parts + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: _Range) -> Iterator:
        import pyarrow as pa

        if partition is None:  # Spark asks for one empty split where there is none
            return
        first, last = partition.value
        for at in range(first, last, BATCH):
            ids = range(at, min(at + BATCH, last))
            x = np.stack(self.make(ids, _Draws(ids, self.seed), **self.params), 1)
            offsets = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(ids.start, ids.stop), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())),
                 pa.array(np.ones(len(ids)))], ["id", "x", "weight"])


class _BatchReader(_Points, DataSourceReader):
    low, high = 0, None

    def pushFilters(self, filters):
        """Bounds on ``id`` narrow the range that is generated; the others stay with Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("id",) and isinstance(value, int):
                high = self.rows if self.high is None else self.high
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, value)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(high, value + 1)
                if isinstance(f, LessThan):
                    self.high = min(high, value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                    continue
            yield f

    def partitions(self):
        return self.split(self.low, self.rows if self.high is None else self.high)


class _StreamReader(_Points, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.rate = float(options["rowsPerSecond"]) if "rowsPerSecond" in options else None
        self.since = float(options["since"]) if self.rate is not None else 0.0

    def initialOffset(self):
        return {"id": 0}

    def latestOffset(self):
        if self.rate is None:
            return {"id": self.rows}
        return {"id": max(0, min(self.rows, int((time.time() - self.since) * self.rate)))}

    def partitions(self, start, end):
        return self.split(start["id"], end["id"])


class PointSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "id long, x array<double>, weight double"

    def reader(self, schema):
        return _BatchReader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; pushes bounds on ``id`` into the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PointSource)
