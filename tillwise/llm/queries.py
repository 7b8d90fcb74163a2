"""The llm queries: one per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillwise.llm import chat_format, conversation_repair, merkle, mixing, url_filter
from tillwise.llm.decontaminate import contamination
from tillwise.llm.language_id import identify_languages
from tillwise.llm.line_dedup import line_report
from tillwise.llm.minhash import near_duplicates
from tillwise.llm.quality_classifier import quality_scores
from tillwise.llm.quality_rules import quality_verdicts
from tillwise.llm.substring_dedup import dedup_substrings
from tillwise.llm.token_output import read_tokens, write_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"), with_text=False)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"))).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(_table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_report(_table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_report(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_substring_dedup, op2_minhash_near_dedup, op3_language_id, op4_line_dedup, op5_mixing, op6_quality_classifier,
           op7_decontamination, op8_token_output, op9_url_filter, op10_quality_rules, op11_conversation_repair, op12_merkle_manifest,
           op13_chat_format)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.oracle_sql(), "op9_url_filter": url_filter.ORACLE_SQL, "op11_conversation_repair": conversation_repair.ORACLE_SQL,
            "op12_merkle_manifest": merkle.ORACLE_SQL, "op13_chat_format": chat_format.ORACLE_SQL}
