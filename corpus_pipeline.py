"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cipherledger.llm import kn_toxicity, secret_linking, sentencepiece_codec, simhash_vptree, source_mixing
from cipherledger.llm.common import fresh_dir, table

STAGES = [
    ("toxicity", kn_toxicity.stage),
    ("near_dedup", simhash_vptree.stage),
    ("secrets", secret_linking.stage),
    ("mixing", source_mixing.stage),
    ("sentencepiece", sentencepiece_codec.tokenized),
]

#: Language models, iterative weights and Viterbi search have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    home = fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
