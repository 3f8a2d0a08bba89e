"""Spark session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}

#: Whether Spark removes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that go to a Python worker at once, or one row.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(app: str = "colloquy", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the library relies on.

    On a cluster leave ``master`` unset and let the submit command choose it;
    ``spark.checkpoint.dir`` should name a folder every executor can reach.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only when the setting is absent in local mode (tests) is a temporary folder
    made, once per session; on a cluster its absence is an error, because
    executors would each write to a disk of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_colloquy_dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark._colloquy_dir = made
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches of one plan need the same expensive frame: the
    lineage is cut in storage that outlives any executor, and the re-read table
    has real size statistics for the planner. Nothing reads the shuffles of the
    write again, so Spark removes their files when it ends. Workers get ``batch``
    bytes at once, where rows are large.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    with shuffles_removed(spark), changed(spark, BATCH, batch):
        df.write.parquet(path)
    kept = spark.read.schema(schema).parquet(path)
    kept.folders = [path]
    return kept


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end within it leave no shuffle files."""
    with changed(spark, CLEANUP, "true"):
        yield


@contextmanager
def changed(spark: SparkSession, key: str, value: str | int | None) -> Iterator[None]:
    """A setting for what runs within it; as it is where there is no value."""
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def emptied(spark: SparkSession, *frames) -> None:
    """Remove the files of what :func:`materialize` wrote (``folders``) and nothing reads any more; the folders stay, empty."""
    for path in (f for frame in frames for f in getattr(frame, "folders", ())):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for x in files.listStatus(at):
            files.delete(x.getPath(), True)
