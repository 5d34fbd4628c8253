"""Pipeline stages: each takes (spark, docs, sf_dir) and returns a DataFrame; all but packing return docs' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.llm.common import pick, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    from fotolake.llm.op10_quality_classifier import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by links (0.75), and of rows with one id, the one with the least id stays.

    Documents without words and rows without an id are in no group and stay.  Of several rows of the id that stays
    the one with the least hash of all its columns stays.
    """
    from fotolake.llm.op7_jaccard_join import jaccard_join

    stay = jaccard_join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    every = F.struct(*flat.columns)
    met = flat.join(stay, F.col(f"_c{docs.columns.index('doc_id')}") == F.col("_stay"))
    met = met.groupBy("_stay").agg(F.min_by(every, F.xxhash64(*flat.columns)).alias("x")).select("x.*").toDF(*docs.columns)
    return met.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    from fotolake.llm.op4_decontamination import decontaminate

    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    from fotolake.llm.op8_pii import redact, train

    clean = redact(docs, train(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in training sequences."""
    import public_tokenizers

    from fotolake.llm.op2_packing import pack_documents

    return pack_documents(pick(docs, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
