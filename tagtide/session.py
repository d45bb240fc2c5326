"""Session defaults and the shared folder for checkpoints and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tagtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE on)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # A day of open posts is too much state for the heap.
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` decides. Only where nothing set it (a test run in
    one process) is a folder made here and handed to the session.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and current.isDefined():
        return current.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"tagtide-{uuid.uuid4().hex[:12]}")
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """A small per-tag result that several branches of a plan read, computed once.

    It is checkpointed in the shared folder, so it outlives a lost executor and
    none of its readers goes back to the posts.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
