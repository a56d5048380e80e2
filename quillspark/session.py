"""Session construction and shared-storage helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "quillspark") -> SparkSession:
    """Session with AQE (coalescing + skew join) on and the UI off; used by tests and bench."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none (local tests) is a private folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="quill-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quill-{name}-{uuid.uuid4().hex[:12]}"




def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more; it does so when the driver's JVM collects them."""
    gc.collect()
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.java.lang.System.gc()


_SCAN_PARTITIONS: dict[tuple[str, str], int] = {}


def balanced(df, key: tuple[str, str] | None = None):
    """Round-robin repartition only when the scan has fewer partitions than the session's parallelism.

    A large input split over many files already has enough scan tasks and is left alone; a single
    unsplittable file (one row group) would otherwise run all per-row work in one task. The scan's
    partition count is planned once per (application, path).
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        if key is not None and key in _SCAN_PARTITIONS:
            n = _SCAN_PARTITIONS[key]
        else:
            n = df.rdd.getNumPartitions()
            if key is not None:
                _SCAN_PARTITIONS[key] = n
    except Exception:  # noqa: BLE001 - sessions without RDD access (Spark Connect) keep the scan as is
        return df
    return df.repartition(target) if n < target else df


def table(spark: SparkSession, sf_dir: str, name: str, balance: bool = False):
    """Read one of the given parquet tables.

    ``balance`` is for reads that feed heavy per-row work (tokenization): such a scan is rebalanced
    when it has too few partitions. Thin reads (ids, labels) are left as scanned.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    return balanced(df, (spark.sparkContext.applicationId, path)) if balance else df
