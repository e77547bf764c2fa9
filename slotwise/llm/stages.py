"""The stages of the corpus pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, packing, personal_data, set_join, toxicity
from .common import stored, table

ORACLE_SQL = None  # tokenizers and trained models stand in it


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine rejects go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("_toxicity", toxicity.toxicity(docs, model))
    return scored.filter("_toxicity < 0.3").drop("_toxicity")


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of id and text, never null: ids may be shared or null, and rows that are
    equal in both have one decision."""
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays, one of a null id
    only if no other is there. Rows of one id with texts that don't link all stay."""
    keyed = _keyed(docs)
    groups = set_join.jaccard_components(keyed.select(F.col("_key").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    ids = keyed.select("_key", "doc_id").distinct().join(groups, "_key")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "_key")).alias("first"))
    kept = keyed.join(first.select("first._key"), "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window stay."""
    keyed = _keyed(docs)
    found = decontamination.contamination(
        keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")
    )
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(hit, "_key", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows the text."""
    found = docs.withColumn("_found", personal_data.personal_data(docs))
    masked = found.withColumn("text", personal_data.masked(docs, F.col("_found.spans")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard join", drop_copies),
    ("decontamination", decontaminate),
    ("personal data", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on `documents`, each on what its predecessor has stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
