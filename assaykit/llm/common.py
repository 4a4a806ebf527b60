"""Small helpers that several operators share."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
# Vocabulary of the encoding queries; the operators take a path.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, whatever else the table holds.

    Columns are taken by position, so extra columns that differ in case only, or repeat a name,
    make no reference ambiguous.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def tasks_for(df: DataFrame) -> int:
    """Partitions for an explicit exchange: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
