"""Queries that fit models, and the two file-stream jobs.

Fitted numbers have no SQL equivalent, so these are checked by invariants in the tests.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from assaykit.functions.fingerprint import modal_widths
from assaykit.operators import adversarial, ensemble, features, models, scoring, splits
from assaykit.plans import experiment as ex
from assaykit.plans import fixtures as fx
from assaykit.plans import sql
from assaykit.plans.catalog import query, rounded
from assaykit.session import materialize, scratch_path
from assaykit.streaming import jobs

TREES = {"n_estimators": 10, "max_depth": 4}


def _config(**changes) -> ex.ExperimentConfig:
    base = ex.ExperimentConfig(
        fingerprints=["fp_part", "fp_supp"], numerics=["mw", "alogp"], label="label", group="group_id", id_col="compound_id"
    )
    return ex.replace(base, **changes)


def _predictions(spark, sf, **changes):
    return ex.run_experiment(fx.compounds_file(spark, sf), _config(**changes)).predictions


@query("svd_variance")
def svd_variance(spark, sf):
    vectors = fx.table(spark, sf, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = features.TruncatedSVD(inputCol="v", outputCol="reduced", k=16).fit(vectors)
    return features.variance_table(model, spark)


@query("svd_sweep")
def svd_sweep(spark, sf):
    df = fx.compounds_file(spark, sf)
    widths = modal_widths(df, ["fp_part", "fp_supp"])
    encoder = ex.feature_stages(_config(numerics=[]), widths)[0]
    encoded = encoder.transform(df).select("__fp").persist()
    try:
        return features.svd_sweep(encoded, "__fp", 500)
    finally:
        encoded.unpersist()


@query("train_logistic")
def train_logistic(spark, sf):
    return _predictions(spark, sf)


@query("train_forest")
def train_forest(spark, sf):
    return _predictions(spark, sf, model_name="random_forest", model_params=TREES)


@query("train_boosted")
def train_boosted(spark, sf):
    return _predictions(spark, sf, model_name="xgboost", model_params=TREES)


_STEP = """WITH x AS (
    SELECT o_orderkey AS compound_id, CAST(o_orderpriority = '1-URGENT' AS INT) AS y, CASE WHEN o_orderpriority = '1-URGENT' THEN 12.0 ELSE 1.0 END AS w,
      [CAST(o_orderstatus = 'F' AS INT), CAST(o_totalprice > 150000 AS INT), CAST(o_custkey % 3 = 0 AS INT), CAST(o_orderkey % 7 = 0 AS INT)] AS f FROM orders),
  t AS (SELECT SUM(w * y) / SUM(w) AS p FROM x),
  gh AS (SELECT x.*, w * (p - y) AS g, w * p * (1 - p) AS h, ln(p / (1 - p)) AS base FROM x, t),
  s AS (SELECT j, SUM(g) FILTER (f[j] = 0) AS g0, SUM(h) FILTER (f[j] = 0) AS h0, SUM(g) FILTER (f[j] = 1) AS g1, SUM(h) FILTER (f[j] = 1) AS h1
    FROM gh, (SELECT unnest([1, 2, 3, 4]) AS j) GROUP BY j),
  b AS (SELECT * FROM s ORDER BY g0 * g0 / (h0 + 1.5) + g1 * g1 / (h1 + 1.5) DESC, j LIMIT 1)
  SELECT compound_id, ROUND(1 / (1 + exp(-(base - 0.3 * CASE WHEN f[j] = 0 THEN g0 / (h0 + 1.5) ELSE g1 / (h1 + 1.5) END))), 6) AS prob FROM gh, b"""


@query("boosted_step", _STEP)
def boosted_step(spark, sf):
    """One boosted tree with one split over binary features, which SQL can say in closed form."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    flags = [F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000, F.col("o_custkey") % 3 == 0, F.col("o_orderkey") % 7 == 0]
    rows = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("compound_id"), urgent.cast("int").alias("label"), array_to_vector(F.array(*[f.cast("double") for f in flags])).alias(models.FEATURES)
    )
    params = {"n_estimators": 1, "learning_rate": 0.3, "max_depth": 1, "reg_lambda": 1.5}
    model = Pipeline(stages=models.classifier_stages("xgboost", "label", params)).fit(rows)
    return rounded(model.transform(rows).select("compound_id", "prob"), "prob")


@query("train_boosted_leaves")
def train_boosted_leaves(spark, sf):
    """Best-first trees with penalties on both kinds of fingerprints."""
    params = {"n_estimators": 5, "num_leaves": 31, "reg_lambda": 1.0, "reg_alpha": 0.1, "learning_rate": 0.1}
    return _predictions(spark, sf, model_name="lightgbm", model_params=params)


@query("end_to_end_scores")
def end_to_end_scores(spark, sf):
    """Parse, reduce, scale and classify as one fitted pipeline, scored on the held-out groups."""
    return _predictions(spark, sf, fp_mode="count", svd_components=20)


@query("grid_search")
def grid_search(spark, sf):
    tuning = {"kind": "grid", "space": {"n_components": [8, 16], "C": [0.1, 1.0]}, "folds": 3}
    cfg = _config(fp_mode="count", svd_components=8, tuning=tuning)
    return ex.run_experiment(fx.compounds_file(spark, sf), cfg).trials


@query("sampled_search")
def sampled_search(spark, sf):
    space = {"C": ["float", 0.01, 10.0, "log"], "penalty": ["categorical", ["l1", "l2"]], "max_iter": ["int", 20, 60]}
    cfg = _config(tuning={"kind": "sampled", "space": space, "n_trials": 3, "folds": 5})
    return ex.run_experiment(fx.compounds_file(spark, sf), cfg).trials


def _metric_row(result: ex.ExperimentResult):
    part = lambda f: F.col("`1`")[f]
    return result.metrics.select(
        part("precision").alias("precision"),
        part("recall").alias("recall"),
        part("f1-score").alias("f1_score"),
        "accuracy",
        "roc_auc_score",
        F.lit(result.threshold).alias("threshold"),
    )


@query("experiment_metrics")
def experiment_metrics(spark, sf):
    cfg = _config(optimize_threshold=True, export_dir=scratch_path(spark, "runs"))
    return _metric_row(ex.run_experiment(fx.compounds_file(spark, sf), cfg))


@query("experiment_adversarial")
def experiment_adversarial(spark, sf):
    scores = fx.adv_scores(spark, sf).select("compound_id", "adversarial_score")
    cfg = _config(split="adversarial", test_size=0.15)
    return _metric_row(ex.run_experiment(fx.compounds_file(spark, sf).join(scores, "compound_id"), cfg))


@query("sweep_run")
def sweep_run(spark, sf):
    cfg = _config(export_dir=scratch_path(spark, "sweep"))
    named = fx.compounds_file(spark, sf).withColumnsRenamed({"fp_part": "ECFP6", "fp_supp": "MACCS"})
    return ex.run_sweep(named, cfg, [["ECFP6"], ["MACCS"], ["ECFP6", "MACCS"]])


@query("adversarial_scores")
def adversarial_scores(spark, sf):
    train, new = fx.sources(spark, sf)
    scored = adversarial.adversarial_scores(
        train, new, "compound_id", ["fp_part", "fp_supp"], ["MW", "ALOGP"], TREES
    )
    return scored.select("compound_id", "label", "adversarial_score")


# Rows that no model is fitted on: they play the new data, as in ``fixtures.sources``.
_IS_NEW, _KNOWN = "compound_id % 5 = 0", "compound_id % 5 != 0"


def _experts(table) -> dict[str, PipelineModel]:
    """One logistic model per fingerprint and one on the numbers alone."""
    kinds = {"part": (["fp_part"], []), "supp": (["fp_supp"], []), "numbers": ([], ["mw", "alogp"])}
    out = {}
    for name, (fps, nums) in kinds.items():
        cfg = _config(fingerprints=fps, numerics=nums)
        widths = modal_widths(table, fps) if fps else {}
        stages = [*ex.feature_stages(cfg, widths), *models.classifier_stages(cfg.model_name, cfg.label, {"max_iter": 50})]
        out[name] = Pipeline(stages=stages).fit(table)
    return out


def _split_and_experts(spark, sf):
    table = materialize(splits.group_holdout(fx.compounds_file(spark, sf), "group_id", "label", 0.2), "split")
    train, held = table.where("NOT is_test"), table.where("is_test")
    return _experts(train), train, held


@query("batch_scores")
def batch_scores(spark, sf):
    """Score with a model that was saved and loaded again."""
    table, new = fx.sources(spark, sf)
    cfg = _config(numerics=["MW", "ALOGP"], export_dir=scratch_path(spark, "runs"))
    model, _ = ex.load_run(spark, ex.run_experiment(table, cfg).run_dir)
    return scoring.batch_scores(model, new, ids=("RandomID", "compound_id"))


@query("expert_scores_subset")
def expert_scores_subset(spark, sf):
    experts, train, held = _split_and_experts(spark, sf)
    everything = train.unionByName(held)
    scored = ensemble.expert_scores(experts, everything, held.select("compound_id"), "compound_id")
    return scored.select("compound_id", *experts)


@query("stacked_scores")
def stacked_scores(spark, sf):
    """Experts, meta model and scored rows are three disjoint sets."""
    table = fx.compounds_file(spark, sf)
    known = splits.group_holdout(table.where(_KNOWN), "group_id", "label", 0.2)
    known = materialize(known, "split")
    experts = _experts(known.where("NOT is_test"))
    new = table.where(_IS_NEW).drop("label")
    stacked = ensemble.stacked_scores(experts, known.where("is_test"), new, "compound_id", "label")
    return ensemble.rank_by_confidence(stacked, "compound_id", "meta_probability", "uncertainty")


@query("ensemble_evaluation")
def ensemble_evaluation(spark, sf):
    experts, _, held = _split_and_experts(spark, sf)
    return ensemble.evaluate_ensemble(
        experts, held, "compound_id", "label", forest_params={"n_estimators": 20, "max_depth": 5}
    )


def _landed(spark, table):
    path = scratch_path(spark, "landing")
    table.write.parquet(path)
    return path, table.schema


@query("stream_scores")
def stream_scores(spark, sf):
    cfg = _config()
    table = fx.compounds_file(spark, sf)
    model = ex.run_experiment(table.where(_KNOWN), cfg).model
    source, schema = _landed(spark, table.where(_IS_NEW))
    sink = scratch_path(spark, "scored")
    job = jobs.score_files(spark, model, source, schema, sink, scratch_path(spark, "state"), ("compound_id",), 2)
    job.awaitTermination()
    return spark.read.parquet(sink)


@query(
    "stream_minmax",
    f"""WITH {sql.COMPOUNDS}, e AS (
      SELECT 'fp_part' AS "column", CAST(unnest(string_split(fp_part, ',')) AS INT) AS v FROM compounds
      UNION ALL SELECT 'fp_supp', CAST(unnest(string_split(fp_supp, ',')) AS INT) FROM compounds)
    SELECT "column", MIN(v) AS min_value, MAX(v) AS max_value FROM e GROUP BY 1""",
)
def stream_minmax(spark, sf):
    source, schema = _landed(spark, fx.compounds(spark, sf))
    name = f"ranges_{uuid.uuid4().hex[:12]}"
    return jobs.drain_ranges(spark, source, schema, ["fp_part", "fp_supp"], scratch_path(spark, "state"), name)
