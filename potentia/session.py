"""Session helpers: a tuned local session for tests/bench and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | str | None = None, app: str = "potentia",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session used by tests and bench. On a cluster, build your own session;
    nothing in the library depends on these settings except the checkpoint folder."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (8 if cpus == "*" else max(2, int(cpus)))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("POTENTIA_DRIVER_MEM", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, honouring ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage named by the cluster in
    ``spark.checkpoint.dir``; we never invent one there. Only a local-mode session
    with nothing configured (tests, bench) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        try:
            conf = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf = None
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage "
                           "so iterative operators can cut lineage reliably")
    path = tempfile.mkdtemp(prefix="potentia-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never ``localCheckpoint``.

    The frame is persisted first so the checkpoint write reuses the computed blocks instead
    of running the whole plan a second time; the cache is released once the files exist.
    """
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist(blocking=False)
    return out


def delete_checkpoint(spark: SparkSession, path: str | None) -> None:
    """Delete the files of a checkpoint that nothing reads any more; Spark does so when the driver's JVM happens to collect
    its garbage, and only if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_cut(df: DataFrame) -> None:
    """Delete what :func:`cut_lineage` wrote for ``df``, which must not be read again."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        path = plan.rdd().getCheckpointFile()
        delete_checkpoint(df.sparkSession, path.get() if path.isDefined() else None)


def drop_shuffle(shuffled) -> None:
    """Remove the files of an RDD made by ``partitionBy``; should a block that came of it be lost, Spark makes them again."""
    cleaner = shuffled.ctx._jsc.sc().cleaner()
    if cleaner.isDefined():  # values <- ShuffledRDD <- its dependency
        made = shuffled._jrdd.rdd().dependencies().apply(0).rdd().dependencies().apply(0)
        cleaner.get().doCleanupShuffle(made.shuffleId(), False)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more; by itself it waits until the driver's JVM
    runs short of memory, which a driver that holds little never does."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def checkpoint_with_sums(df: DataFrame, keys: list, sums: dict, key_col: str = "problem_id"):
    """Checkpoint ``df`` and, in the same job, sum each named expression per key value.

    ``keys`` is a bounded list (problem ids); the sums ride along as ``observe`` metrics,
    so an iterative round costs one Spark job instead of a write plus a separate reduction.
    Returns (checkpointed DataFrame, {key: {name: value}}).
    """
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    obs = Observation()
    aggs = [F.sum(F.when(F.col(key_col) == F.lit(k), e)).alias(f"{name}__{i}")
            for i, k in enumerate(keys) for name, e in sums.items()]
    out = cut_lineage(df.observe(obs, *aggs)) if aggs else cut_lineage(df)
    got = obs.get if aggs else {}
    return out, {k: {name: (got.get(f"{name}__{i}") or 0.0) for name in sums} for i, k in enumerate(keys)}


_SHIPPED: set[str] = set()
_ZIP: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Make ``potentia`` importable in the Python workers (the Arrow kernels live in it):
    zip the package once and ``addPyFile`` it once per SparkContext - what ``--py-files``
    does on a cluster. Idempotent and cheap after the first call."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if not _ZIP:
        root = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="potentia-pkg-", dir="/tmp"), "potentia.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for dirpath, dirnames, files in os.walk(root):
                dirnames[:] = [d for d in dirnames if d != "__pycache__"]
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        z.write(full, os.path.join("potentia", os.path.relpath(full, root)))
        _ZIP.append(out)
    sc.addPyFile(_ZIP[0])
    _SHIPPED.add(app)
