"""Tables written once and read again: to cut a lineage, to keep one state of a source, to replace a path that is being read."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Only in local mode, where that is unset, a temporary folder takes its place; on a
    cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder for staged tables."""
    return f"{base_folder(spark)}/tidemark-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession, older_than_hours: float = 24) -> int:
    """Deletes staged tables of this library that nobody has written to for so long; the number of folders that went."""
    place = spark._jvm.org.apache.hadoop.fs.Path(base_folder(spark))
    fs, before = place.getFileSystem(spark._jsc.hadoopConfiguration()), (time.time() - 3600 * older_than_hours) * 1000
    if not fs.exists(place):
        return 0
    old = [f.getPath() for f in fs.listStatus(place) if f.getPath().getName().startswith("tidemark-") and f.getModificationTime() < before]
    return sum(bool(fs.delete(p, True)) for p in old)


def snapshot(df: DataFrame) -> DataFrame:
    """df as it is now: every later step reads the same rows, whatever happens to the source."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_path(df: DataFrame, path: str) -> None:
    """Overwrites a Parquet path that df may be reading: staged beside it, then renamed."""
    publish(df.sparkSession, staged_beside(df, path), path)


def staged_beside(df: DataFrame, path: str) -> str:
    """df written once, beside the path that it is to replace."""
    staged = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    return staged


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Puts a staged table in a path's place. If that fails, OSError, and the old table is where it was."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    new, now, old = place(staged), place(path), place(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(now)

    def renamed(a, b) -> bool:
        try:
            return fs.rename(a, b)
        except Py4JJavaError:
            return False

    if there and not renamed(now, old):
        raise OSError(f"{path} can't be moved away")
    if not renamed(new, now):
        if there and not renamed(old, now):
            raise OSError(f"{staged} can't be moved to {path}; the old table is in {old.toString()}")
        raise OSError(f"{staged} can't be moved to {path}")
    if there:
        fs.delete(old, True)


def remove_partitions(spark: SparkSession, path: str, values: DataFrame) -> None:
    """Deletes the folders of partitions (a row each) of a Parquet path; they come one at a time, however many."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for row in values.select(*[values[c].cast("string") for c in values.columns]).toLocalIterator():
        folder = "/".join(name.getPartitionPathString(c, row[c]) for c in values.columns)
        fs.delete(place(f"{path}/{folder}"), True)
