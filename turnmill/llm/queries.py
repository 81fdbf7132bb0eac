"""The registered queries of this subpackage: thin calls of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import copartition, decontaminate, language_model, minmax, packing, quality, rans, runs, simhash, sql, substring, templates, token_counts, toxicity

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=50256)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = templates.drop_templates(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op8_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encode_and_read_back(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_co_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copartition.co_bucket(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf_dir, "documents"), take=runs.planted, texts=False)


def op13_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_token_counts, op3_toxicity, op4_language_model, op5_substring, op6_quality, op7_templates, op8_rans, op9_decontaminate, op10_simhash, op11_co_bucket, op12_runs, op13_minmax)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Models, tokenizers, hashes and trees have no SQL form; those operators are tested against brute force."""
    return {"op5_substring": sql.substring(), "op6_quality": sql.quality()}
