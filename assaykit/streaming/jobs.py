"""File-stream jobs: score compounds as files land, and keep running fingerprint ranges."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from assaykit.functions.fingerprint import parse_lenient
from assaykit.operators.scoring import batch_scores


def score_files(
    spark: SparkSession,
    model: PipelineModel,
    source: str,
    schema: StructType,
    sink: str,
    state: str,
    ids: tuple[str, ...],
    max_files: int | None = None,
) -> StreamingQuery:
    """Score every file not seen before and append (id, probability) Parquet files.

    ``state`` holds the progress, so a restarted job continues where the last one ended and the
    file sink stays free of duplicates.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    scored = batch_scores(model, reader.parquet(source), ids)
    return (
        scored.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def running_ranges(stream: DataFrame, fp_cols: list[str]) -> DataFrame:
    """Smallest and largest fingerprint element per column so far; two numbers of state each."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), parse_lenient(c).alias("v")) for c in fp_cols])
    )
    return (
        stream.select(pairs.alias("e"))
        .groupBy("e.column")
        .agg(F.min(F.array_min("e.v")).alias("min_value"), F.max(F.array_max("e.v")).alias("max_value"))
    )


def drain_ranges(
    spark: SparkSession, source: str, schema: StructType, fp_cols: list[str], state: str, name: str, max_files: int | None = None
) -> DataFrame:
    """Run the range job over all files present and return its final table."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(source)
    job = (
        running_ranges(stream, fp_cols)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.table(name)
