"""Reading and writing screening tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The fingerprint kinds a screening file may carry.
FINGERPRINT_COLUMNS = [
    "ECFP4", "ECFP6", "FCFP4", "FCFP6", "RDK", "AVALON", "ATOMPAIR", "TOPTOR", "MACCS",
]
# Kinds whose name does not contain "FP".
PLAIN_FINGERPRINT_NAMES = ("MACCS", "RDK", "AVALON", "TOPTOR", "ATOMPAIR")
# Identifier columns in order of preference.
ID_COLUMNS = ("RandomID", "SMILES")
# Spellings brought to one canonical name.
CANONICAL_NAMES = {"AlogP": "ALOGP"}


def require_columns(df: DataFrame, cols: list[str], what: str = "table") -> DataFrame:
    """Fail early, naming every missing column and what is there instead."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {missing}; found {df.columns}")
    return df


def normalize_columns(df: DataFrame) -> DataFrame:
    """Canonical column names; applied to every table that is read."""
    clash = [old for old, new in CANONICAL_NAMES.items() if old in df.columns and new in df.columns]
    if clash:
        raise ValueError(f"both spellings present for {clash}")
    # renaming matches names in any case, so pass only exact spellings
    return df.withColumnsRenamed({old: new for old, new in CANONICAL_NAMES.items() if old in df.columns})


def feature_columns(columns: list[str], fingerprint_name: str = "FP") -> list[str]:
    """Columns that look like fingerprints by their name."""
    return [c for c in columns if fingerprint_name in c or c in PLAIN_FINGERPRINT_NAMES]


def known_fingerprints(columns: list[str]) -> list[str]:
    return [c for c in FINGERPRINT_COLUMNS if c in columns]


def id_column(columns: list[str], candidates: tuple[str, ...] = ID_COLUMNS) -> str | None:
    """First identifier column present, or None."""
    return next((c for c in candidates if c in columns), None)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return normalize_columns(spark.read.parquet(path))


def read_compounds(
    spark: SparkSession,
    path: str,
    fp_cols: list[str],
    num_cols: list[str] | None = None,
    label: str | None = "DELLabel",
    keep: list[str] | None = None,
    max_rows: int | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """Projected scan: only the named columns reach the Parquet reader.

    ``max_rows`` caps the table in ``order_by`` order, which makes the cap repeatable.
    """
    wanted = [*(keep or []), *fp_cols, *(num_cols or []), *([label] if label else [])]
    df = require_columns(read_table(spark, path), wanted, path).select(*dict.fromkeys(wanted))
    return row_cap(df, max_rows, order_by) if max_rows is not None else df


def row_cap(df: DataFrame, n: int, order_by: str | None) -> DataFrame:
    """First ``n`` rows by an explicit order (a top-n, no full sort)."""
    if order_by is None:
        raise ValueError("a row cap needs order_by: file order is not defined on a cluster")
    return df.orderBy(order_by).limit(n)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return normalize_columns(spark.read.csv(path, header=True, schema=schema))


def read_tsv(
    spark: SparkSession, path: str, schema: StructType | str, partitions: int | None = None
) -> DataFrame:
    """Tab-separated text, gzip allowed. A gzip file is one task, so spread it after reading."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return normalize_columns(df.repartition(partitions) if partitions else df)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: str | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",", compression: str | None = None) -> None:
    writer = df.write.mode(mode).option("header", True).option("sep", sep)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_run_metrics(spark: SparkSession, base_dir: str, pattern: str = "*", file: str = "test_metrics.json") -> DataFrame:
    """Metrics of every run folder below ``base_dir``, with the folder name as ``run_name``."""
    path = F.col("_metadata.file_path")
    run = F.element_at(F.split(F.split_part(path, F.lit(f"/{file}"), F.lit(1)), "/"), -1)
    return spark.read.json(f"{base_dir.rstrip('/')}/{pattern}/{file}").select(
        "*", F.url_decode(run).alias("run_name")
    )
