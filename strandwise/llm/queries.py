"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, lm_scoring, near_dedup, packing, sharding, suffix_dedup, token_counts, toxicity, webp


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _t(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.cross_entropy_difference(_t(spark, sf_dir, "documents"), good)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(_t(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budget=1024)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "chars_within", "bytes_within")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_t(spark, sf_dir, "documents"))


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_columns(_t(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_t(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_t(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_t(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.stratified_shards(_t(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_scoring, op2_toxicity, op3_token_counts, op4_suffix_dedup, op5_lossless_webp, op6_html_text, op7_near_duplicates, op8_decontamination, op9_packing, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {}
