"""Tables written on the way, in the folder that driver and executors share, and writes that are kept only if they pass a check."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Only used where spark.checkpoint.dir is unset and Spark runs in one process.
LOCAL_SHARED = "/tmp/checkpoints/gristmill-stages"

_written: dict[str, list[str]] = {}


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return system.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    system, at = _at(spark, path)
    return [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    system, at = _at(spark, path)
    system.delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Rename a path; on HDFS and local disks at once. OSError if the file system refuses."""
    system, at = _at(spark, path)
    if not system.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't be renamed to {to}")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = LOCAL_SHARED
    path = f"{root.rstrip('/')}/{sc.applicationId}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean, spark)
    _written.setdefault(sc.applicationId, []).append(path)
    return path


def _clean(spark: SparkSession) -> None:
    for path in _written.pop(spark.sparkContext.applicationId, []) if spark.sparkContext._jsc else []:
        delete(spark, path)


def staged(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """df written once and read back, in a folder for each value of `by`: filters on those columns read their folders alone."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.select(*[c for c in df.columns if c not in by], *by).schema).parquet(path).select(*df.columns)


def write_observed(df: DataFrame, path: str, form: str, counts: dict[str, Column], check: Callable[[dict], None]) -> dict:
    """Write df in one pass and count on the way: the counts are metrics of the write itself.

    The write goes to a folder beside `path`. check() gets the counts and raises if they won't do; then the folder is
    deleted and what was at `path` stays. Else the folder takes that name.
    """
    spark, seen = df.sparkSession, Observation()
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged"
    try:
        df.observe(seen, *[c.alias(k) for k, c in counts.items()]).write.format(form).save(beside)
        said = dict(seen.get)
        check(said)
        if exists(spark, path):
            old = f"{beside}.old"
            rename(spark, path, old)
            rename(spark, beside, path)
            delete(spark, old)
        else:
            rename(spark, beside, path)
    finally:
        delete(spark, beside)
    return said
