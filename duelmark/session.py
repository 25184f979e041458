"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a task's sorts and hash tables hold many times what it reads compressed, so that partitions are not merged beyond this
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "duelmark", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a
    machine-local path would be lost with the machine, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), "duelmark-checkpoints")


def app_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; removed when the driver's interpreter ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/duelmark-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS[folder] = spark
        atexit.register(drop_path, spark, folder)
    return folder


_FOLDERS: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's folder."""
    return f"{app_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system that holds it; nothing happens once the JVM is gone."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  at interpreter exit the gateway may have closed already
        pass


# removes the shuffle files of an execution when it ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, partition_by: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (to ``path`` there, or a fresh one) and read it back.

    Cuts lineage in a way that survives executor loss: the rows live in shared
    storage, not in executor block managers. The shuffle files that led to them are removed at once, so a chain
    of steps needs disk for one step's shuffles and not for all.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    before = spark.conf.get(CLEANUP, None)
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
