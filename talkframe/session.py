"""Spark session construction and the checkpoint directory contract."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of this package relies on. AQE re-plans joins at runtime (broadcast
# when the measured side is small, skew splitting otherwise); ANSI stays on, so code uses try_*.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime (measured) size under which AQE turns a shuffle join into a broadcast; the
    # vocabulary / query-side tables fall under it at test scale and above it at corpus scale
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
# Settings of a single machine only: executors elsewhere could not reach a loopback driver.
LOCAL_CONF = {"spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1"}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "talkframe", extra: dict | None = None) -> SparkSession:
    """Session builder. On a cluster, pass master=None and let spark-submit decide master, memory,
    host and shuffle width; a local master gets loopback, 8 shuffle partitions and 16 GB."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if (master or "").startswith("local"):
        conf.update(LOCAL_CONF)
        shuffle_partitions = shuffle_partitions or 8
        conf.setdefault("spark.driver.memory", os.environ.get("TALKFRAME_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that one is always used. Only
    when it is unset, on a local master (tests), a fresh scratch folder is created; elsewhere a
    folder of one machine would lose data, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="talkframe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df):
    """Reliable checkpoint (never localCheckpoint): survives executor loss, keeps partitioning.

    The frame is persisted first: writing a reliable checkpoint otherwise recomputes it in a
    second job. The cache is dropped once the checkpoint files exist.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def stored(df, name: str):
    """``df`` written once as Parquet in the session's shared folder and read back.

    Like ``cut_lineage`` it survives lost executors; being columnar, later passes read only the
    columns they need. The partitioning is that of the written files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
