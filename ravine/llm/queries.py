"""Each operator over its whole table, as the registry's opN_ queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravine.llm import chat, fmindex, mixing, nbsvm, oracles, quality, sharding, simhash, suffixes, templates, tokens, valid_time, warc, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize_documents(_read(spark, sf_dir, "documents"), added=True)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_documents(_read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_documents(_read(spark, sf_dir, "documents"))


def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.dedup_documents(_read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaked_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op12_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_time.enrich_sales(_read(spark, sf_dir, "sales"), _read(spark, sf_dir, "client_changes"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_warc, op3_token_ids, op4_suffix_array, op5_simhash, op6_fm_index, op7_mixing, op8_quality_classifier, op9_quality_rules, op10_decontamination, op11_whitening, op12_valid_time, op13_chat)
}
ORACLES: dict[str, str] = oracles.ORACLES
