"""Folders through Hadoop's file system, wherever they are."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it is missing."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def file_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of all files below a path; none if it is missing."""
    at, fs = _at(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder to a name that is free; the folders above it are made."""
    at, fs = _at(spark, source)
    to, _ = _at(spark, target)
    fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(at, to):
        raise OSError(f"cannot move {source} to {target}")
