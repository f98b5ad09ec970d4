"""Folders of the cluster's file systems: what is in them, marks, and removal."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, folder: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(conf), path


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _place(spark, folder)
    return files.exists(path)


def entries(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder and when each was changed, in seconds; nothing if there is no folder."""
    files, path = _place(spark, folder)
    if not files.exists(path):
        return {}
    return {at.getPath().getName(): at.getModificationTime() / 1000 for at in files.listStatus(path)}


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file, which is there at once or not at all."""
    files, at = _place(spark, path)
    files.create(at, True).close()


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder or file; one that is gone is no error."""
    files, path = _place(spark, folder)
    files.delete(path, True)
