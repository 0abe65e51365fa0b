"""Intermediate tables in the folder that driver and executors share.

Cutting lineage with a written table survives the loss of any executor: the
files belong to no executor, and a task that reads them can be run again
anywhere.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Whether Spark deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, since a machine-local folder would
    be invisible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lorewell-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/lorewell-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes within leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def write(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back; its shuffle files go with the write."""
    spark = df.sparkSession
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    return write(df, new_path(df.sparkSession, name))


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call when its results are consumed."""
    remove(spark, f"{root(spark)}/lorewell-{spark.sparkContext.applicationId}")
