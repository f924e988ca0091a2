"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "tidebar", master: str | None = None, partitions: int | None = None):
    """A session with the settings every operator here assumes.

    ``master`` and ``partitions`` are for local runs; on a cluster leave both
    unset so that the submit-time configuration and AQE decide.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone; bars are UTC throughout."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a session in one process may go without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR")))
    return context.getCheckpointDir()


def store_once(df):
    """Write an intermediate result that several later steps read, and cut its lineage.

    Goes to the reliable checkpoint folder, so it outlives lost executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
