"""Intermediate results that are used more than once, kept on shared storage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Stored bytes from which the shuffle files behind an intermediate are worth a collection.
LARGE_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a scratch folder only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="slotwise-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results are stored.

    Its cleaner follows the collection of the driver's objects, which may not happen for
    long on its own; between two large jobs their files would lie side by side.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path of a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def forget(*frames: DataFrame) -> None:
    """Deletes what `durable` has stored for `frames`, which nothing may read any more."""
    for df in frames:
        system, place = _folder(df.sparkSession, df._durable_path)
        system.delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back.

    The rest of the plan starts from stored rows of known size: nothing before is computed
    twice, a lost executor repeats only its own part, and small results can be broadcast on
    account of their measured size.
    """
    path = f"{shared_folder(df.sparkSession)}/slotwise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, place = _folder(df.sparkSession, path)
    if system.getContentSummary(place).getLength() >= LARGE_BYTES:
        release(df.sparkSession)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._durable_path = path
    return found
