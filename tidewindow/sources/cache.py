"""Tables kept as Parquet under a signature of what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def file_facts(spark: SparkSession, path: str) -> dict:
    """Path, size and time of change of a file in any store."""
    fs, at = _fs(spark, path)
    status = fs.getFileStatus(at)
    return {"path": path, "size": status.getLen(), "modified": status.getModificationTime()}


def signature(sources: Mapping, schema_version: str, settings: Mapping) -> str:
    """SHA-256 of sources, version and settings, whatever the order of keys."""
    told = {"sources": sources, "schema_version": schema_version, "settings": settings}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def signature_column(settings: Column) -> Column:
    """SHA-256 of a struct column as JSON."""
    return F.sha2(F.to_json(settings), 256)


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """The table of a signature and whether it was there; else it is made and written.

    A table counts as there once its job has committed, so a broken attempt is made again.
    """
    path = f"{folder}/{key}"
    fs, done = _fs(spark, f"{path}/_SUCCESS")
    hit = fs.exists(done)
    if not hit:
        make().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path), hit


def label_free(windows: DataFrame) -> DataFrame:
    """The windows themselves, or an error if any of them has a label."""
    if not windows.where(F.col("label").isNotNull()).limit(1).isEmpty():
        raise ValueError("these windows must not have labels")
    return windows
