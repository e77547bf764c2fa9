"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.plans.lineage import release, shared_folder  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(
    df: DataFrame, name: str, compression: str | None = None, group_bytes: int | None = None
) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Spark reads up to 4,096 rows of a row group at once and keeps them in memory. Where single
    rows are of megabytes, `group_bytes` makes row groups of about that size, so that no task
    holds more, however many rows its files have.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write
    if group_bytes:
        writer = writer.options(**{"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1})
    writer.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 4; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """True in the fold that no model learns from; a null id is not in it."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def slices(texts: pd.Series, chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts of a batch, null as "", in lists of about `chars` characters or one text."""
    part: list[str] = []
    size = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if part and size + len(text) > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


_KEPT: dict = {}


def kept(make: Callable, *key):
    """`make(*key)`, which this worker process keeps from task to task; one such object at a time."""
    if (make, key) not in _KEPT:
        forget()
        _KEPT[make, key] = make(*key)
    return _KEPT[make, key]


def forget() -> None:
    """Drops what earlier tasks of this worker process have kept.

    Spark's workers outlive a job, so that the memories of a pipeline's last stage would lie
    beside what the next job needs.
    """
    _KEPT.clear()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Whole texts go to Python in small batches, unless the user chose a size already.

    With the default of 10,000 rows a run of long texts would make a batch of gigabytes.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, str(rows))
