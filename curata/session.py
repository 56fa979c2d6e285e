"""Session helpers: local defaults for tests and bench, shared scratch space."""

from __future__ import annotations

import os
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app_name: str = "curata",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library assumes.

    On a cluster pass ``master=None`` and let the deployment decide; only the
    SQL settings below are forced because results depend on them (UTC, AQE).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Set a checkpoint folder only when the session has none (tests, bench)."""
    root = checkpoint_root(spark)
    if not root:
        os.makedirs(fallback, exist_ok=True)
        spark.sparkContext.setCheckpointDir(fallback)
        root = fallback
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_root(spark: SparkSession) -> str | None:
    """Folder for written intermediate tables: the cluster's
    ``spark.checkpoint.dir``. The warehouse folder is used instead only on a
    ``local[...]`` master, where driver and executors share one disk; its
    default (``./spark-warehouse``) is machine-local on a cluster."""
    root = checkpoint_root(spark)
    if root:
        return root
    if spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir", None)
    return None


_FOLDERS: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table under :func:`shared_root`. Never a
    machine-local temporary folder. All tables of an application share a
    folder that goes when the application ends."""
    root = shared_root(spark)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach "
                           "(HDFS, S3, ABFS) to write intermediate tables")
    folder = f"{root.rstrip('/')}/curata-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, cut_lineage: bool = False) -> DataFrame:
    """Compute an intermediate table once and keep it.

    By default the table is persisted (memory, spilling to disk); if an
    executor is lost its blocks are recomputed from lineage. With
    ``cut_lineage`` the table is written as parquet under the shared folder
    named by ``spark.checkpoint.dir`` (or the warehouse folder) and read back:
    the plan restarts from those files, which survive executor loss, stay
    columnar (later reads prune columns) and keep column metadata. Without a
    shared folder (see :func:`shared_root`) it persists instead. Never
    ``localCheckpoint``.
    """
    spark = df.sparkSession
    if cut_lineage and shared_root(spark):
        path = scratch_path(spark, "table")
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


#: Rows that may be kept as literals of a plan.
LITERAL_ROWS = 20_000


def kept_rows(df: DataFrame) -> tuple[DataFrame, int]:
    """A per-group table computed once, and its row count, without a cached
    entry left behind: up to ``LITERAL_ROWS`` rows become literals of the
    plan, more are written to the shared folder."""
    rows = df.limit(LITERAL_ROWS + 1).collect()
    if len(rows) <= LITERAL_ROWS:
        return df.sparkSession.createDataFrame(rows, df.schema), len(rows)
    kept = materialize(df, cut_lineage=True)
    return kept, kept.count()
