import json
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from assaykit.operators import adversarial, ensemble, features, models, scoring
from assaykit.plans import experiment as ex
from assaykit.plans import fixtures as fx


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 300
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0.4).astype(int)
    return pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1] * 10 + 3, "c": x[:, 2], "y": y})


def test_scaler_uses_population_std_and_zeroes_constants(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0)], "a double, k double")
    rows = features.scale_columns(df, ["a", "k"]).collect()
    v = np.array([1.0, 2.0, 4.0])
    assert [r["a_scaled"] for r in rows] == pytest.approx(list((v - v.mean()) / v.std()))
    assert [r["k_scaled"] for r in rows] == [0.0, 0.0, 0.0]


def svd_input(spark, n=80, width=12):
    rng = np.random.default_rng(2)
    x = (rng.random((n, width)) < 0.3).astype(float)
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in range(n)], "id long, x array<double>")
    return x, df.select("id", array_to_vector("x").alias("v"))


@pytest.mark.parametrize("limit", [4096, 4])
def test_svd_matches_numpy(spark, monkeypatch, tmp_path, limit):
    """Both ways of computing it: from the Gram matrix and by the iterative solver."""
    monkeypatch.setattr(features, "MAX_GRAM_WIDTH", limit)
    x, df = svd_input(spark)
    model = features.TruncatedSVD(inputCol="v", outputCol="r", k=4).fit(df)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    got = np.array([r["r"].toArray() for r in model.transform(df).orderBy("id").collect()])
    want = x @ vt[:4].T
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)
    ratio = want.var(axis=0) / x.var(axis=0).sum()
    assert model.explained_variance_ratio == pytest.approx(ratio, abs=1e-8)
    path = str(tmp_path / "svd")
    PipelineModel([model]).save(path)
    again = np.array([r["r"].toArray() for r in PipelineModel.load(path).transform(df).orderBy("id").collect()])
    assert again == pytest.approx(got)


def test_sweep_stops_below_the_width(spark):
    _, df = svd_input(spark)
    rows = features.svd_sweep(df, "v", 500).orderBy("component").collect()
    assert len(rows) == 11
    cumulative = [r["cumulative"] for r in rows]
    assert cumulative == sorted(cumulative) and cumulative[-1] <= 1 + 1e-9


def logistic_optimum(x, y, w, lam, steps=50):
    """Weighted L2 logistic regression with a free intercept, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    pen = np.diag([lam] * x.shape[1] + [0.0])
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (w * (p - y)) + pen @ beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + pen
        beta -= np.linalg.solve(hess, grad)
    return beta


def test_logistic_is_the_balanced_penalized_optimum(spark, table):
    df = spark.createDataFrame(table)
    stages = [*ex.feature_stages(ex.ExperimentConfig(numerics=["a", "b", "c"]), {}), *models.classifier_stages("logistic_regression", "y", {"C": 0.5})]
    model = Pipeline(stages=stages).fit(df)
    x = table[["a", "b", "c"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    y = table.y.to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    want = logistic_optimum(x, y, w, 1 / 0.5)
    fitted = next(s for s in model.stages if hasattr(s, "coefficients"))
    assert [*fitted.coefficients.toArray(), fitted.intercept] == pytest.approx(want, abs=1e-4)


def test_saved_model_scores_the_same_and_knows_its_threshold(spark, table, tmp_path):
    df = spark.createDataFrame(table)
    stages = [*ex.feature_stages(ex.ExperimentConfig(numerics=["a", "b"]), {}), *models.classifier_stages("random_forest", "y", {"n_estimators": 5, "max_depth": 3})]
    model = models.with_threshold(Pipeline(stages=stages).fit(df), 0.7)
    model.save(str(tmp_path / "m"))
    cols = ["id", "prob", "predicted"]
    first = model.transform(df).select(cols).orderBy("id").collect()
    assert first == PipelineModel.load(str(tmp_path / "m")).transform(df.drop("y")).select(cols).orderBy("id").collect()
    assert all(0 <= r["prob"] <= 1 and r["predicted"] == int(r["prob"] >= 0.7) for r in first)


def test_model_factory_errors(spark):
    with pytest.raises(ValueError, match="not recognized"):
        models.make_classifier("svm")
    with pytest.raises(ValueError, match="boosting_type"):
        models.make_classifier("lightgbm", {"num_leaves": 31, "boosting_type": "dart"})
    tuned = models.make_classifier("catboost", {"depth": 10, "l2_leaf_reg": 1.3, "learning_rate": 0.2}, "ignore")
    settings = json.loads(tuned.getOrDefault(tuned.settings))
    assert settings["depth"] == 10 and settings["rate"] == 0.2
    plain = models.make_classifier("catboost", {"depth": 10, "learning_rate": 0.2})
    assert plain.getMaxDepth() == 10 and plain.getStepSize() == 0.2


def test_weights_need_both_classes(spark):
    with pytest.raises(ValueError, match="both classes"):
        models.ClassWeighter(labelCol="y").fit(spark.createDataFrame([(1,), (1,)], "y int"))


def test_sampled_parameters_are_seeded_and_in_range():
    space = {"a": ["int", 3, 10], "b": ["float", 0.01, 0.3, "log"], "c": ["float", 1, 2], "d": ["categorical", ["x", "y"]]}
    draws = models.sampled_parameters(space, 50, 7)
    assert draws == models.sampled_parameters(space, 50, 7) != models.sampled_parameters(space, 50, 8)
    assert all(3 <= d["a"] <= 10 and 0.01 <= d["b"] <= 0.3 and 1 <= d["c"] <= 2 and d["d"] in "xy" for d in draws)


def test_grid_has_every_combination():
    assert len(models.parameter_grid({"a": [1, 2, 3], "b": [0, 1]})) == 6


@pytest.fixture(scope="module")
def compounds(spark, small):
    return fx.compounds(spark, small).cache()


def config(**changes):
    return ex.ExperimentConfig(
        **{"fingerprints": ["fp_part", "fp_supp"], "numerics": ["mw"], "label": "label", "group": "group_id", "id_col": "compound_id", **changes}
    )


def test_run_saves_everything_and_reloads(spark, compounds, tmp_path):
    result = ex.run_experiment(compounds, config(optimize_threshold=True, export_dir=str(tmp_path), svd_components=5, run_name="r"))
    model, settings = ex.load_run(spark, result.run_dir)
    assert settings["widths"] == {"fp_part": 64, "fp_supp": 32} and settings["run_name"] == "r"
    assert {p.name for p in (tmp_path / result.run_dir.rsplit("/", 1)[1]).iterdir() if p.suffix != ".crc"} == {
        "config.json", "test_metrics.json", "model", "threshold_optimization", "svd_variance.json"
    }
    want = {r["compound_id"]: (round(r["prob"], 9), r["predicted"]) for r in result.predictions.collect()}
    got = {r["compound_id"]: (round(r["prob"], 9), r["predicted"]) for r in model.transform(compounds).collect()}
    assert want and all(got[k] == v for k, v in want.items())


def test_cluster_column_keeps_clusters_in_one_fold(compounds):
    folds = ex.cv_folds(compounds, config(cluster_col="group_id"), 4)
    assert folds.groupBy("group_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_search_refits_best(spark, table):
    df = spark.createDataFrame(table).withColumn("fold", (F.col("id") % 3).cast("int"))
    stages = ex.feature_stages(ex.ExperimentConfig(numerics=["a", "b", "c"]), {})
    fitted, trials = models.search(df, stages, "logistic_regression", "y", models.parameter_grid({"C": [1e-4, 1.0]}), "fold")
    rows = trials.orderBy("trial").collect()
    assert len(rows) == 2 and all(0 < r["f1_weighted"] <= 1 for r in rows)
    assert "prob" in fitted.bestModel.transform(df).columns


def test_missing_feature_is_an_error(compounds):
    with pytest.raises(ValueError, match="missing column"):
        ex.run_experiment(compounds.drop("mw"), config())


def test_scoring_an_absent_block_as_zeros(spark, compounds):
    cfg = config(numerics=[])
    stages = [*ex.feature_stages(cfg, {"fp_part": 64, "fp_supp": 32}), *models.classifier_stages("logistic_regression", "label", {"max_iter": 5})]
    model = Pipeline(stages=stages).fit(compounds)
    blank = compounds.withColumn("fp_part", F.lit(None).cast("string"))
    absent = compounds.drop("fp_part")
    ids = ("RandomID", "compound_id")
    with pytest.raises(ValueError, match="missing"):
        scoring.batch_scores(model, absent, ids)
    want = {tuple(r) for r in scoring.batch_scores(model, blank, ids).collect()}
    assert {tuple(r) for r in scoring.batch_scores(model, absent, ids, on_missing="zero").collect()} == want
    assert scoring.batch_scores(model, compounds).columns == ["DELLabel"]


def test_trees_are_fitted_in_tasks_of_a_bounded_size(spark, compounds, tmp_path, monkeypatch):
    """A table of few bytes is one split of a file, however many values its rows hold."""
    compounds.coalesce(1).write.parquet(f"{tmp_path}/table")
    table, tasks, fit = spark.read.parquet(f"{tmp_path}/table").withColumnRenamed("mw", "MW"), [], GBTClassifier._fit

    def recorded(self, df):
        tasks.append(df.rdd.getNumPartitions())
        return fit(self, df)

    monkeypatch.setattr(GBTClassifier, "_fit", recorded)
    monkeypatch.setattr(models, "VALUES_PER_TASK", table.count() * 97 // 32)
    params, new = {"n_estimators": 1, "max_depth": 1}, table.where("compound_id % 5 = 0").drop("label")
    adversarial.adversarial_scores(table.where("compound_id % 5 != 0"), new, "compound_id", ["fp_part", "fp_supp"], ["MW"], params)
    ex.run_experiment(table, config(model_name="xgboost", model_params=params, numerics=["MW"]))
    assert len(tasks) == 2 and min(tasks) >= 20


@pytest.mark.parametrize("cross_fit", [False, True])
def test_adversarial_scores_find_the_shift(spark, cross_fit):
    """Training rows that look like the new data score higher."""
    df = spark.range(400).select(
        F.col("id").alias("k"), F.lit("1,0").alias("FP1"), (F.col("id") % 100).cast("double").alias("MW"), F.lit(1.0).alias("ALOGP")
    )
    new = df.where("MW >= 60").withColumnRenamed("ALOGP", "AlogP")
    out = adversarial.adversarial_scores(df, new, "k", ["FP1"], ["MW", "ALOGP"], {"n_estimators": 5, "max_depth": 2}, cross_fit)
    assert out.count() == 400 and "is_test" not in out.columns
    low, high = (out.where(c).agg(F.avg("adversarial_score")).first()[0] for c in ("MW < 60", "MW >= 60"))
    assert 0 <= low < 0.2 < high <= 1


def test_row_statistics_match_numpy(spark):
    v = np.random.default_rng(1).random((20, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "i int, a double, b double, c double")
    rows = df.select("i", ensemble.row_mean(["a", "b", "c"]).alias("m"), ensemble.row_std(["a", "b", "c"]).alias("s")).orderBy("i").collect()
    assert [r["m"] for r in rows] == pytest.approx(v.mean(1)) and [r["s"] for r in rows] == pytest.approx(v.std(1))


def test_ensemble_comparison_lists_all_models(spark, table):
    df = spark.createDataFrame(table)
    experts = {}
    for name in ("a", "c"):
        stages = [*ex.feature_stages(ex.ExperimentConfig(numerics=[name]), {}), *models.classifier_stages("logistic_regression", "y")]
        experts[f"on_{name}"] = Pipeline(stages=stages).fit(df)
    rows = ensemble.evaluate_ensemble(experts, df, "id", "y", forest_params={"n_estimators": 5, "max_depth": 3}).collect()
    assert {r["model"] for r in rows} == {"Ensemble (Average)", "Stacking (Logistic Regression)", "Stacking (Random Forest)", "on_a", "on_c"}
    auc = [r["roc_auc"] for r in rows]
    assert auc == sorted(auc, reverse=True)


@pytest.mark.parametrize(
    "name, params",
    [
        ("logistic_regression", {"penalty": "elasticnet"}),
        ("logistic_regression", {"penalty": None}),
        ("random_forest", {"max_depth": 31}),
        ("xgboost", {"max_depth": -1}),
        ("catboost", {"depth": 0}),
    ],
)
def test_parameters_that_spark_cannot_honour_raise(spark, name, params):
    with pytest.raises(ValueError, match=next(iter(params)).removeprefix("max_")):
        models.make_classifier(name, params, on_unsupported="ignore")


def test_sweep_has_the_same_rows_by_either_solver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 20))
    rows = [(int(i), x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x array<double>").select(array_to_vector("x").alias("v"))
    tables = []
    for limit in (4096, 4):
        monkeypatch.setattr(features, "MAX_GRAM_WIDTH", limit)
        tables.append([tuple(r) for r in features.svd_sweep(df, "v", 8).orderBy("component").collect()])
    assert len(tables[0]) == len(tables[1]) == 8
    assert np.array(tables[0]) == pytest.approx(np.array(tables[1]), abs=1e-8)


def test_tuned_component_counts_reach_the_trials(spark, tmp_path):
    rng = np.random.default_rng(7)
    n = 240
    bits = (rng.random((n, 12)) < 0.4).astype(int)
    y = (bits[:, 3] + bits[:, 8] + rng.normal(size=n) * 0.3 > 0.9).astype(int)
    rows = [(i, i % 40, int(y[i]), ",".join(map(str, bits[i]))) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, g long, y int, ECFP6 string")
    for tuning in (
        {"kind": "grid", "space": {"n_components": [1, 10]}},
        {"kind": "sampled", "space": {"n_components": ["categorical", [1, 10]]}, "n_trials": 4},
    ):
        cfg = ex.ExperimentConfig(
            run_name="t", model_name="logistic_regression", model_params={"max_iter": 20}, fingerprints=["ECFP6"], label="y",
            group="g", id_col="row_id", tuning=tuning,
        )
        found = ex.run_experiment(df, cfg).trials.collect()
        assert len({round(r["f1_weighted"], 6) for r in found}) > 1
        assert len({(r["params"], round(r["f1_weighted"], 6)) for r in found}) == len({r["params"] for r in found})


def test_a_component_count_without_an_owner_is_an_error(spark, table):
    df = spark.createDataFrame(table).withColumn("fold", F.col("id") % 3)
    with pytest.raises(ValueError, match="n_components"):
        models.search(df, [], "logistic_regression", "y", [{"n_components": 2}], "fold")


def test_class_weights_can_be_set():
    weight = lambda *args: models.weighting_for(*args).getOrDefault("positiveWeight")
    assert weight("xgboost", "y", {"scale_pos_weight": 3}) == 3.0
    assert weight("random_forest", "y", {"class_weight": None}) == 1.0
    assert weight("catboost", "y", {"class_weight": "balanced"}) == 0.0
    assert weight("catboost", "y") == models.POSITIVE_WEIGHT
    for bad in ({"scale_pos_weight": 0}, {"class_weight": {0: 1, 1: 2}}):
        with pytest.raises(ValueError):
            models.weighting_for("xgboost", "y", bad)
    models.make_classifier("xgboost", {"scale_pos_weight": 3})


def test_projection_of_a_batch_with_sparse_dense_and_empty_rows(monkeypatch):
    rng = np.random.default_rng(3)
    basis = rng.standard_normal((30, 4))
    rows = [np.where(rng.random(30) < 0.2, rng.standard_normal(30), 0.0) for _ in range(40)] + [np.zeros(30)] * 2
    dense = [i % 5 == 0 for i in range(42)]
    index = pa.array([None if d else np.flatnonzero(r).tolist() for r, d in zip(rows, dense)], pa.list_(pa.int32()))
    value = pa.array([r.tolist() if d else r[r != 0].tolist() for r, d in zip(rows, dense)], pa.list_(pa.float64()))
    want = np.array(rows) @ basis
    for most in (1 << 22, 40, 1):
        monkeypatch.setattr(features, "SLICE_NUMBERS", most)
        assert np.allclose(np.array(features.project_batch(index, value, basis).to_pylist()), want)
        assert np.allclose(np.array(features.project_batch(index[7:], value[7:], basis).to_pylist()), want[7:])
    assert features.project_batch(index[:0], value[:0], basis).to_pylist() == []
