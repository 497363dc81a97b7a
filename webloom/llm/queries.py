"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import attention_lm, chat_tree, decontamination, jaccard, licenses, mixing, pii, quality, sharding, suffix_dedup, vector_codes, warc, whitening


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.webloom.pii.key", "a key for the test tables only").encode()
    return pii.replace(spark.read.parquet(f"{sf_dir}/documents.parquet"), pii.PiiConfig(key))


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.digests(chat_tree.with_odd(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_sharding": op2_sharding,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_mixing": op4_mixing,
        "op5_pii": op5_pii,
        "op6_attention_lm": op6_attention_lm,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_warc": op8_warc,
        "op9_decontamination": op9_decontamination,
        "op10_license_scan": op10_license_scan,
        "op11_vector_codes": op11_vector_codes,
        "op12_whitening": op12_whitening,
        "op13_chat_tree": op13_chat_tree,
    }


def oracle_sql() -> dict[str, str]:
    from webloom.llm import oracles

    return oracles.all_sql()
