"""Token counts through a cache of content digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices, stored
from .tokenize import ByteCounter, file_digest

CACHE = T.StructType(
    [
        T.StructField("tokenizer", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def content(text: str) -> Column:
    """The normalised content: null is the empty text, all else stays as it is, since the
    tokenizer has no normaliser and every character counts."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored counts, or None where nothing has been stored yet."""
    java = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = java.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(CACHE).parquet(path) if files.exists(java) else None


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> DataFrame:
    """`docs` with `n_bytes` (UTF-8) and `n_tokens` of each whole text.

    `tokenizer` is the file of a byte-level tokenizer that every executor has. `cache` is a
    folder that all share: a Parquet table of (tokenizer version, content digest, count). The
    digests of the texts are joined with it, only distinct contents that it lacks are encoded,
    and their counts are appended before the result is read from it.

    Null texts are empty and have 0 tokens; repeated rows stay and share one cache row; an
    empty table gives an empty result and an empty cache; columns of `docs` named n_bytes or
    n_tokens are replaced. Copies are combined in the scan, before the shuffle of the texts
    to encode; where the cache has most contents, few texts are shuffled at all.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    version = file_digest(tokenizer)
    keyed = docs.withColumn("_digest", F.sha2(content(text), 256))
    todo = keyed.select("_digest", content(text).alias("_text"))
    known = read_cache(spark, cache)
    if known is not None:
        known = known.filter(F.col("tokenizer") == version).select(F.col("digest").alias("_digest"))
        missing = stored(keyed.select("_digest").distinct().join(known, "_digest", "left_anti"), "missing")
        todo = todo.join(missing, "_digest", "left_semi")

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = ByteCounter(tokenizer)
        for part in parts:
            counts = [n for texts in slices(part["_text"]) for n in counter.counts(texts)]
            yield pd.DataFrame({"tokenizer": version, "digest": part["_digest"], "n_tokens": counts})

    new = todo.dropDuplicates(["_digest"]).mapInPandas(encode, CACHE)
    new.write.mode("append").parquet(cache)
    # A run that was cut off may have appended some counts twice; they are equal.
    counts = (
        spark.read.schema(CACHE).parquet(cache)
        .filter(F.col("tokenizer") == version)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    return (
        keyed.drop("n_tokens")
        .withColumn("n_bytes", F.octet_length(content(text)).cast("long"))
        .join(counts, "_digest", "left")
        .drop("_digest")
    )
