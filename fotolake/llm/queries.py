"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fotolake.llm.common import table


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fotolake.llm.op1_token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fotolake.llm.op2_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fotolake.llm.op3_sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fotolake.llm.op4_decontamination import decontamination_report

    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fotolake.llm.op7_jaccard_join import jaccard_report

    return jaccard_report(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fotolake.llm.op8_pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fotolake.llm.op9_quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fotolake.llm.op5_url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fotolake.llm.op6_token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fotolake.llm.op10_quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_packing, op3_sharding, op4_decontamination, op5_url_filter,
        op6_token_files, op7_jaccard_join, op8_pii, op9_quality_rules, op10_quality_classifier,
    )
}
ORACLE_SQL: dict[str, str] = {}
