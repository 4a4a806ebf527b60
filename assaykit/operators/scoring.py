"""Scoring new compounds with a fitted pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.fingerprint import FingerprintEncoder
from assaykit.sources.tables import ID_COLUMNS, id_column, normalize_columns


def tolerate_missing(model: PipelineModel) -> PipelineModel:
    """The same model, filling an absent fingerprint column with zeros instead of failing."""
    stages = [
        s.copy({s.onMissing: "zero"}) if isinstance(s, FingerprintEncoder) else s for s in model.stages
    ]
    return PipelineModel(stages)


def batch_scores(
    model: PipelineModel,
    df: DataFrame,
    ids: tuple[str, ...] = ID_COLUMNS,
    on_missing: str = "error",
    prob_name: str = "DELLabel",
) -> DataFrame:
    """(id, probability) of every row; without an id column the probability alone."""
    table = normalize_columns(df)
    chosen = id_column(table.columns, ids)
    scored = (tolerate_missing(model) if on_missing == "zero" else model).transform(table)
    return scored.select(*([chosen] if chosen else []), F.col("prob").alias(prob_name))
