"""The flagship query: from fingerprint text to a ranked list with a tuned threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators.ordered import global_rank
from assaykit.plans import fixtures as fx
from assaykit.plans.experiment import ExperimentConfig, run_experiment


def ranked_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out compounds by descending probability, with the decision at the best F1 threshold."""
    cfg = ExperimentConfig(
        run_name="flagship",
        fingerprints=["fp_part", "fp_supp"],
        numerics=["mw", "alogp"],
        label="label",
        group="group_id",
        id_col="compound_id",
        optimize_threshold=True,
    )
    result = run_experiment(fx.compounds_file(spark, sf), cfg)
    ranked = global_rank(result.predictions, [F.desc("prob"), F.col("compound_id")], "rank")
    return ranked.withColumn("threshold", F.lit(result.threshold))
