"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "almanack", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC days, AQE and skew-join handling switched on.

    Partition counts are left to the cluster; a local run passes its own.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Where none is named, a folder below the user's home on the default file system: the one that
    a cluster's executors share. With a default file system that is local, only a local session
    has it in common with its executors, so anything else is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        files = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
        if files.getUri().getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        home = "file:/tmp" if files.getUri().getScheme() == "file" else files.getHomeDirectory().toString()
        named = f"{home}/almanack-{spark.sparkContext.applicationId}"
        spark.conf.set(CHECKPOINT_KEY, named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path below the shared folder, for tables and stream state."""
    return os.path.join(checkpoint_root(spark), *parts, uuid.uuid4().hex)


def durable(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage, so that a lost executor cannot change the rows."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
