"""The corpus pipeline: quality, line dedup, near dedup, mixing, encoding. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import stages
from assaykit.session import materialize

STAGES = [
    ("quality_classifier", stages.keep_quality),
    ("line_dedup", stages.drop_repeated_lines),
    ("minhash_near_dedup", stages.keep_one_of_each_group),
    ("mix_sources", stages.mix),
    ("bpe_encode", stages.encode),
]

# The classifier is fitted iteratively, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
