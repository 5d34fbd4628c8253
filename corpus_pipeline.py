"""From raw documents to packed training sequences: five operators, each a stage of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fotolake.llm.common import materialize, table
from fotolake.llm.stages import decontamination, one_of_each_group, packing, pii, quality

STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("best-fit packing", packing),
]

#: Trained models and a tokenizer decide here, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
