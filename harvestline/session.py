"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "harvestline", master: str | None = None,
                  shuffle_partitions: int | None = None, checkpoint_dir: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on: UTC calendar, adaptive
    re-planning with skew-join splitting, Arrow transfer for the few Python steps.
    ``checkpoint_dir`` is the folder all executors share; checkpoints go when their frames do."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if checkpoint_dir:
        builder = builder.config(CHECKPOINT_KEY, checkpoint_dir)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. The cluster names it in
    ``spark.checkpoint.dir``; only a local session without it gets a temporary one."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        path = tempfile.mkdtemp(prefix="harvestline-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for an intermediate table."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, so a lost
    executor costs a re-read, and every later branch sees the same rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=eager)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver started. Where
    it is installed on the executors or given by ``--py-files`` this only adds a copy."""
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_harvestline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="harvestline-package-")  # read by the driver only
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "harvestline"), "zip", os.path.dirname(root), os.path.basename(root)))
    sc._harvestline_shipped = True
