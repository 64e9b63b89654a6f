"""Session settings and the shared scratch folder."""

import atexit
import functools
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package expects (UTC, ANSI, AQE, no UI)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the folder that all executors share.

    The folder is ``spark.checkpoint.dir``. Where that is unset a temporary
    folder is used in local mode only; on a cluster that is an error, because
    executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_dir()
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex[:12]}")


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="tickloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For intermediate tables that several later steps read. Unlike a cache it
    survives the loss of executors without recomputing. ``discard`` deletes it.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._materialized_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for frame in frames:
        path, spark = frame._materialized_at, frame.sparkSession
        jvm = getattr(spark, "_jvm", None)
        if jvm is not None:
            hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries that nothing refers to any more.

    It does so once the driver's garbage collector has run, which may take long
    without this call. Does nothing where the driver's handles are not there.
    """
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()
