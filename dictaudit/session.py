"""Spark session and checkpoint-directory helpers.

On a cluster the session is created by the platform; these helpers only read its settings. The
checkpoint directory is taken from ``spark.checkpoint.dir``; a private one is created only for
local-mode sessions (tests, bench) where the setting is absent.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # LLM stages must not be re-run by a speculative copy of a task.
    "spark.speculation": "false",
}


def get_spark(master: str | None = None, app: str = "dictaudit", shuffle_partitions: int | None = None,
              driver_memory: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, creating a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="dictaudit-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint directory for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` once as Parquet into the shared checkpoint directory and
    reading it back.

    Same effect as a reliable ``checkpoint()`` (a lost executor re-reads the files instead of
    recomputing the lineage), but one job instead of two: an eager ``checkpoint()`` runs the plan
    once to count and again to write unless the data is also cached.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._scratch_path = path
    return out


def discard(df) -> None:
    """Delete a table that ``materialize`` wrote, once everything made from it is written itself."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark) -> None:
    """Let the driver collect its garbage, so that Spark removes the shuffle files of plans that are written
    and gone. By itself it may keep them until its heap is full, whatever the disks hold."""
    spark.sparkContext._jvm.System.gc()
