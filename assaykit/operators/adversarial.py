"""How much a training row looks like the new data: scores from a source classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.fingerprint import FingerprintEncoder, modal_widths
from assaykit.operators.features import NumericScaler
from assaykit.operators.models import FEATURES, ClassWeighter, ProbabilityThreshold, make_classifier, spread_to_fit
from assaykit.operators.splits import seeded_order
from assaykit.sources.tables import normalize_columns

SOURCE = "is_test"


def mark_sources(train: DataFrame, new: DataFrame, cols: list[str]) -> DataFrame:
    """Both tables under one schema, 1 for rows of the new data."""
    return (
        normalize_columns(train).select(*cols).withColumn(SOURCE, F.lit(0))
        .unionByName(normalize_columns(new).select(*cols).withColumn(SOURCE, F.lit(1)))
    )


def source_model(fp_cols: list[str], num_cols: list[str], widths: dict[str, int], params: dict | None = None) -> Pipeline:
    """Unweighted boosted trees telling the two sources apart."""
    return Pipeline(
        stages=[
            FingerprintEncoder(inputCols=fp_cols, widths=[widths[c] for c in fp_cols], outputCol="__fp"),
            NumericScaler(inputCols=num_cols, outputCol="__num"),
            VectorAssembler(inputCols=["__fp", "__num"], outputCol=FEATURES),
            ClassWeighter(labelCol=SOURCE, positiveWeight=1.0),
            make_classifier("lightgbm", params),
            ProbabilityThreshold(threshold=0.5),
        ]
    )


def adversarial_scores(
    train: DataFrame,
    new: DataFrame,
    id_col: str,
    fp_cols: list[str],
    num_cols: list[str],
    params: dict | None = None,
    cross_fit: bool = False,
    seed: int = 42,
) -> DataFrame:
    """``train`` with ``adversarial_score``, the probability of belonging to the new data.

    The score is added to the row it was computed from, so nothing is aligned by position. By
    default the model scores rows it was trained on; ``cross_fit`` trains on one half of all rows
    and scores the other half, both ways.
    """
    train = normalize_columns(train)
    both = mark_sources(train, new, [id_col, *fp_cols, *num_cols])
    widths = modal_widths(both, fp_cols)
    both = spread_to_fit(both, both.count(), sum(widths.values()) + len(num_cols)).persist()
    try:
        plan = source_model(fp_cols, num_cols, widths, params)
        target = train.withColumn(SOURCE, F.lit(0))
        if not cross_fit:
            parts = [(plan.fit(both), target)]
        else:
            half = F.conv(F.substring(seeded_order(id_col, seed), 1, 1), 16, 10).cast("int") % 2
            parts = [(plan.fit(both.where(half != h)), target.where(half == h)) for h in (0, 1)]
        scored = [
            m.transform(t).select(*train.columns, F.col("prob").alias("adversarial_score")) for m, t in parts
        ]
    finally:
        both.unpersist()
    return scored[0] if len(scored) == 1 else scored[0].unionByName(scored[1])
