"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local sessions and an error on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='gleaner-')}"
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; it is removed when this process ends."""
    path = f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[set[str]]:
    """Scratch tables that are written inside are removed at the end, but for the paths that are added to the set it gives."""
    kept: set[str] = set()
    _open.append([])
    try:
        yield kept
    finally:
        made = _open.pop()
        if _open:
            _open[-1].extend(p for p in made if p in kept)
        for path in made:
            if path not in kept:
                _forget(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, wherever it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # the session may be gone already
        pass


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def materialize_by(df: DataFrame, name: str, key: str, codec: str = "zstd") -> DataFrame:
    """As `materialize`, but dealt into one bucket of `key` for each shuffle partition: joins on `key` leave the rows where they are."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    entry = "gleaner_" + path.rpartition("-")[2]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartition(parts, f"`{key}`").write.format("parquet").option("compression", codec).option("path", path)
    dealt.bucketBy(parts, key).saveAsTable(entry)
    atexit.register(_unlist, spark, entry)
    out = spark.table(entry)
    out._scratch = path
    return out


def _unlist(spark: SparkSession, entry: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {entry}")
    except Exception:  # the session may be gone already
        pass
