"""Where jobs put their shared intermediate files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for local runs."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="barscreen-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage.

    The files go with the DataFrame if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/barscreen/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, below the application's own folder."""
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has staged; for the end of a session.

    DataFrames that read staged tables can't be used afterwards, nor stores or stream states in
    folders from ``new_folder``.
    """
    delete_folder(spark, _session_folder(spark))


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none if it is not there."""
    if not folder_exists(spark, path):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return [status.getPath().getName() for status in found]


@contextmanager
def staging(spark: SparkSession, label: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A stage function whose folder goes away once the block has succeeded."""
    root = new_folder(spark, label)

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    yield stage
    delete_folder(spark, root)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors and keeps column pruning and filter pushdown.
    Shuffle files go as soon as the table is written: nothing reads them again.
    """
    path = new_folder(df.sparkSession, label)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_SHUFFLE_CLEANUP, None)
    conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_SHUFFLE_CLEANUP) if before is None else conf.set(_SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
