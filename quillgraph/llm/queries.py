"""Registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, idfiles, jaccard, licenses, oracles, packing, quality, substring, toxicity, urls
from .base import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.written_and_read(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("span_starts", "span_ends")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_report(table(spark, sf_dir, "documents")).drop("removed_starts", "removed_ends")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).drop(*quality.RATES)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_url_filter, op2_token_id_files, op3_chat_formatting, op4_benchmark_decontamination, op5_packing, op6_license_scan, op7_substring_dedup, op8_toxicity, op9_quality_rules, op10_jaccard_join)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express whole. Tokens (op2, op5), models (op1, op8) and chains (op6) are tested against brute force."""
    return {"op3_chat_formatting": chat.ORACLE, "op4_benchmark_decontamination": oracles.OP4, "op7_substring_dedup": oracles.OP7, "op9_quality_rules": oracles.OP9, "op10_jaccard_join": oracles.OP10}
