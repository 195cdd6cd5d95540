"""Structured Streaming forms of ingest, assignment and streaming k-means.

* T1  text vector files as a file-source stream (``maxFilesPerTrigger`` = batch size in files).
* T4  stateless stream-static assignment: the centroid table is size-checked and broadcast,
      every micro-batch is scored by the same Arrow kernel as the batch path (append mode).
* T2/T3 stateful seeding / refinement: the centroid state is global (not keyed), at most
      ``max_centroids`` rows, so ``foreachBatch`` updates a table of versions, one a ``batch_id``,
      which a restarted query reads back. A micro-batch may hold many numbered batches: what a batch costs is
      then a job on its own rows, not a start, a listing and a commit.
* T5  progress: ``numInputRows`` per micro-batch from the query progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potentia.operators import cluster as C
from potentia.operators import neighbors as N
from potentia.operators.staged import StagedPoints
from potentia.sources.vectors import parse_vector_lines


def vector_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1,
                  split_char: str | None = None) -> DataFrame:
    """Micro-batch ingest of text vector files -> streaming ``label, x``."""
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path))
    return parse_vector_lines(lines, split_char=split_char, mode="DROP")


def point_stream(spark: SparkSession, path: str, schema: str = "id long, x array<double>",
                 files_per_trigger: int = 1) -> DataFrame:
    """Parquet point files as a stream (one or more files per micro-batch)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def assign_stream(stream: DataFrame, centroids: DataFrame) -> DataFrame:
    """T4: nearest centroid for every streamed point (no aggregation, so append mode)."""
    return N.nearest(stream, centroids)


def run_to_table(df: DataFrame, out_path: str, ckpt: str | None = None) -> tuple[DataFrame, list[int]]:
    """Drive a streaming frame to completion (``availableNow``) into parquet; return the
    written table and the per-batch input row counts (T5)."""
    spark = df.sparkSession
    ckpt = ckpt or f"{out_path.rstrip('/')}_ckpt"
    q = (df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = [int(p.get("numInputRows", 0)) for p in q.recentProgress]
    return spark.read.parquet(out_path), rows


_STATE = ("batch_id long, shift double, z double, seed int, max_centroids int, total_d2 double, total_n long, "
          "initial_mean_d2 double, mean_d2 double, centroids array<struct<centroid_id:long,x:array<double>,n:long>>")


class StoredCentroids:
    """The centroid state of T2/T3 as a table of versions, one folder a micro-batch.

    A version holds the whole state after its batch. A new handle on the same folder goes on from
    the last version, and a batch that a version exists for is a replay and changes nothing, so a
    stopped or failed query resumes with the same result."""

    def __init__(self, spark: SparkSession, path: str, initial: C.CentroidState):
        self.spark, self.path, self.state, self.last = spark, path.rstrip("/"), initial, -1
        row = self._latest()
        if row is not None:
            self.last = row["batch_id"]
            self.state = C.CentroidState(row["max_centroids"], row["shift"], row["z"], row["seed"],
                                         [(c["centroid_id"], list(c["x"]), c["n"]) for c in row["centroids"]],
                                         row["total_d2"], row["total_n"], row["initial_mean_d2"], row["mean_d2"])

    def _latest(self):
        from pyspark.errors import AnalysisException
        try:
            versions = self.spark.read.schema(_STATE).parquet(f"{self.path}/v*")
            return versions.orderBy(F.desc("batch_id")).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def update(self, batch: DataFrame, batch_id: int, numbered: str | None = None) -> None:
        """One micro-batch: take it and write the version it leads to. ``numbered`` names a column of numbers: the
        micro-batch then holds a batch for each number, which are taken in that order, each a job on its own rows."""
        if batch_id <= self.last:
            return
        if numbered is None:
            self.state.take(batch.select("id", "x"), batch_id, "id")
        else:
            rows = batch.select("id", "x", F.col(numbered).alias("_b"))
            sizes = sorted(tuple(r) for r in rows.groupBy("_b").count().collect())  # a row a batch
            staged, lo = StagedPoints(rows, F.col("_b")), 0
            for number, size in sizes:
                self.state.take_staged(staged, lo, lo + size, number, by_id=True)
                lo += size
        s = self.state
        row = (batch_id, s.shift, s.z, s.seed, s.max_centroids, float(s.total_d2), int(s.total_n), s.initial_mean_d2, s.mean_d2,
               [(int(i), [float(v) for v in x], int(n)) for i, x, n in s.centroids])
        self.spark.createDataFrame([row], _STATE).write.mode("overwrite").parquet(f"{self.path}/v{batch_id:012d}")
        self.last = batch_id


def streaming_kmeans_stream(stream: DataFrame, initial: list[list[float]], *, max_centroids: int,
                            shift: float, z: float, path: str, seed: int = 0, numbered: str | None = None) -> C.CentroidState:
    """T2+T3: seeding and refinement on every micro-batch via ``foreachBatch``, until the input is used
    up; with ``numbered`` each holds the batches that this column numbers. ``path`` holds the versions and the query's checkpoint; called again with the same path (after
    a stop, a failure or for new files) it goes on where the last finished batch ended."""
    store = StoredCentroids(stream.sparkSession, f"{path.rstrip('/')}/state", C.CentroidState(
        max_centroids, shift, z, seed, [(i, list(map(float, x)), 1) for i, x in enumerate(initial)]))
    q = (stream.writeStream.foreachBatch(lambda df, bid: store.update(df, bid, numbered))
         .option("checkpointLocation", f"{path.rstrip('/')}/query").trigger(availableNow=True).start())
    q.awaitTermination()
    return store.state
