"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    decontamination,
    embeddings,
    languages,
    merkle,
    packing,
    passages,
    personal_data,
    repeats,
    secrets,
    set_join,
    statements,
    token_counts,
    toxicity,
)
from .common import is_held_out, scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.toxicity(docs, model).alias("score"))
    high = (F.col("score") >= 0.3).cast("int")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", high.alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.contamination(docs, items)
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so each run encodes what the table holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.count_tokens(docs, path, scratch(spark, "token-cache"))
    over = F.col("n_tokens") > 1024
    return counted.select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"))


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages.language(docs, languages.learn(docs))
    named = docs.select("doc_id", "text").select("doc_id", found.alias("found"))
    return named.select("doc_id", is_held_out().alias("held_out"), "found.*")


def op5_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", personal_data.personal_data(docs).alias("found")).select("doc_id", "found.*")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    found_kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [
        (F.size(found_kinds) - F.size(F.array_remove(found_kinds, k))).cast("long").alias(f"n_{k}")
        for k in kinds
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered rows have one more in n_chars; a null id or count is never tampered with."""
    docs = table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    ours = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    chars = F.when(ours, more).otherwise(F.col("n_chars").cast("string"))
    claimed = merkle.leaf(*(chars if c == "n_chars" else F.col(c) for c in columns))
    made = merkle.manifest(docs, columns, "lang", "doc_id", doc_id=F.col("doc_id"), claimed=claimed)
    root = merkle.folded(F.col("claimed"), F.col("path"), F.col("siblings"))
    return merkle.proofs(made).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("siblings", "").cast("binary"), 256).alias("proof_sha256"),
        root.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path_a, path_b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.alignment(table(spark, sf_dir, "documents"), path_a, path_b)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_decontamination": op2_decontamination,
        "op3_token_counts": op3_token_counts,
        "op4_languages": op4_languages,
        "op5_set_join": op5_set_join,
        "op6_packing": op6_packing,
        "op7_personal_data": op7_personal_data,
        "op8_secrets": op8_secrets,
        "op9_embeddings": op9_embeddings,
        "op10_passages": op10_passages,
        "op11_merkle": op11_merkle,
        "op12_alignment": op12_alignment,
        "op13_repeats": op13_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return statements.oracle_sql()
