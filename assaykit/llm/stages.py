"""The operators as pipeline stages: (spark, docs, sf_dir) to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm.bpe import encode_documents
from assaykit.llm.common import TOKENIZER, pick, table
from assaykit.llm.line_dedup import with_lines_removed
from assaykit.llm.mixing import mixed_documents
from assaykit.llm.near_dedup import keep_one
from assaykit.llm.quality import keep_good


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_lines_removed(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8, as no contract sets others for the stage."""
    return keep_one(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids; small caches, as the Python workers serve the other stages too. Other columns are left out."""
    return pick(encode_documents(docs, TOKENIZER, 150_000), "doc_id", "lang", "source", "n_tokens", "ids")
