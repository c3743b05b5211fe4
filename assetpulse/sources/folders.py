"""Folders of any file system that Spark can open (shared storage on a cluster)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(sc._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _open(spark, path)
    return bool(fs.exists(jpath))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none when it is absent."""
    fs, jpath = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder with what it holds."""
    fs, jpath = _open(spark, path)
    fs.delete(jpath, True)
