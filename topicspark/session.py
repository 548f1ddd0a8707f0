"""Spark session helper and shared-folder handling.

On a cluster the operator of the job names a shared folder in
``spark.checkpoint.dir``; every lineage cut (``checkpoint()``) and every table
we write between steps goes below it.  Only when it is unset (tests, a laptop)
do we create our own folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
}


# SQL settings the queries rely on for correct results; applied at run time to
# any session (also one created by someone else).  With union output
# partitioning on, Spark 4.1 may treat a union of two hash-partitioned
# children as partitioned by the key and skip the exchange a later join or
# aggregate needs (seen as duplicated join rows); it is switched off.
RUNTIME_SQL_CONF = {
    "spark.sql.unionOutputPartitioning": "false",
    # an executor holds a batch on both sides of each Python worker: 10,000 documents would be 30 MB and more
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def configure_session(spark: SparkSession) -> None:
    for k, v in RUNTIME_SQL_CONF.items():
        spark.conf.set(k, v)


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "topicspark", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure_session(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one is made only in local mode, where it may be unset."""
    configure_session(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="topicspark-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table written between steps."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a reused table once to the shared folder (Parquet) and read it back.

    Later steps read only the columns they need, and a lost executor costs a
    re-read instead of a recomputation of the whole lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # the table replaces its shuffles: their files go once it is written
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(key, old)
    return spark.read.parquet(path)
