"""Tables written to the cluster's shared folder, to cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a new temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes of the batches that whole texts are handed to Python in. A batch is held several times over on both
#: sides, and a few thousand long texts make one too large.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to what suits whole texts; smaller settings stay.

    Spark reads these settings when a query is planned, which may be long after an operator has returned, so they aren't set back.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(re.match(r"\d*", spark.conf.get(key))[0] or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a write when it is done: what is written has no use for them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df``, written once as Parquet and read from there; ``partitions`` are columns whose values get files of their own."""
    with _tidy_shuffles(df.sparkSession):
        df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``written`` to a new path of the shared folder."""
    return written(df, new_path(df.sparkSession, name))


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The intermediate tables of one job, in a folder of their own; each can be dropped once no later step reads it."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, new_path(spark, name)
        self._paths: dict[str, str] = {}

    def save(self, name: str, df: DataFrame, partitions: Sequence[str] = ()) -> DataFrame:
        """``df`` as a written table; a name that is used again stands for the newer table and drops the older one."""
        before, path = self._paths.get(name), f"{self.folder}/{name}-{uuid.uuid4().hex}"
        out = written(df, path, partitions)
        self._paths[name] = path
        if before:
            delete_path(self.spark, before)
        return out

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, those of them that there are."""
        for name in names:
            if name in self._paths:
                delete_path(self.spark, self._paths.pop(name))
