"""Train, hold out, evaluate and save; and sweeps over feature sets."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.fingerprint import FingerprintEncoder, modal_widths
from assaykit.functions.scalars import features_from_run_name
from assaykit.operators import metrics, models, splits
from assaykit.operators.features import NumericScaler, TruncatedSVD, variance_table
from assaykit.session import materialize
from assaykit.sources import tables as src


@dataclass(frozen=True)
class ExperimentConfig:
    """All settings of one run; saved with its results."""

    run_name: str = "experiment"
    model_name: str = "logistic_regression"
    model_params: dict = field(default_factory=dict)
    fingerprints: list[str] = field(default_factory=list)
    numerics: list[str] = field(default_factory=list)
    label: str = "DELLabel"
    group: str = "DEL_ID"
    id_col: str = "row_id"
    test_size: float = 0.2
    max_rows: int | None = None
    fp_mode: str = "eq1"
    svd_components: int | None = None
    # "group" holds out whole groups, "adversarial" the rows that look most like new data
    split: str = "group"
    adversarial_col: str = "adversarial_score"
    # folds by this column instead of stratified group folds, when tuning
    cluster_col: str | None = None
    # {"kind": "grid" | "sampled", "space": {...}, "n_trials": 50, "folds": 3 | 5}
    tuning: dict | None = None
    optimize_threshold: bool = False
    export_dir: str | None = None
    on_unsupported: str = "error"
    parallelism: int = 2
    seed: int = 42


@dataclass(frozen=True)
class ExperimentResult:
    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame
    threshold: float
    best_params: dict
    trials: DataFrame | None
    run_dir: str | None


def feature_stages(cfg: ExperimentConfig, widths: dict[str, int]) -> list:
    """Parse, optionally reduce, scale and assemble."""
    stages, parts = [], []
    if cfg.fingerprints:
        stages.append(
            FingerprintEncoder(
                inputCols=cfg.fingerprints,
                widths=[widths[c] for c in cfg.fingerprints],
                mode=cfg.fp_mode,
                outputCol="__fp",
            )
        )
        parts.append("__fp")
        if cfg.svd_components:
            stages.append(TruncatedSVD(inputCol="__fp", outputCol="__svd", k=cfg.svd_components))
            parts = ["__svd"]
    if cfg.numerics:
        stages.append(NumericScaler(inputCols=cfg.numerics, outputCol="__num"))
        parts.append("__num")
    if not parts:
        raise ValueError("an experiment needs fingerprints or numeric features")
    return [*stages, VectorAssembler(inputCols=parts, outputCol=models.FEATURES)]


def hold_out(df: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    if cfg.split == "adversarial":
        return splits.adversarial_split(df, cfg.adversarial_col, cfg.test_size)
    if cfg.split != "group":
        raise ValueError(f"unknown split {cfg.split!r}")
    return splits.group_holdout(df, cfg.group, cfg.label, cfg.test_size, cfg.seed)


def cv_folds(train: DataFrame, cfg: ExperimentConfig, k: int) -> DataFrame:
    if cfg.cluster_col:
        return splits.balanced_group_folds(train, cfg.cluster_col, k)
    return splits.stratified_group_folds(train, cfg.group, cfg.label, k, cfg.seed)


def _needed(cfg: ExperimentConfig) -> list[str]:
    cols = [cfg.id_col, cfg.group, cfg.label, *cfg.fingerprints, *cfg.numerics]
    cols += [cfg.cluster_col] if cfg.cluster_col else []
    cols += [cfg.adversarial_col] if cfg.split == "adversarial" else []
    return list(dict.fromkeys(cols))


def _trials(cfg: ExperimentConfig) -> list[dict]:
    kind, space = cfg.tuning["kind"], cfg.tuning["space"]
    if kind == "grid":
        return models.parameter_grid(space)
    if kind == "sampled":
        return models.sampled_parameters(space, cfg.tuning.get("n_trials", 50), cfg.seed)
    raise ValueError(f"unknown tuning kind {kind!r}")


def _tune(train: DataFrame, cfg: ExperimentConfig, stages: list) -> tuple[dict, DataFrame]:
    """Best parameters and the trial table.

    A grid refits the feature stages in every fold; sampled trials share features fitted once,
    unless they draw the number of components, which refits them too.
    Parsing learns nothing from the rows, so the text is parsed once for either.
    """
    kind = cfg.tuning["kind"]
    folds = cv_folds(train, cfg, cfg.tuning.get("folds", 3 if kind == "grid" else 5))
    trials = _trials(cfg)
    if kind == "grid" or "n_components" in cfg.tuning["space"]:
        for parser in [s for s in stages if isinstance(s, FingerprintEncoder)]:
            folds = parser.transform(folds)
        stages = [s for s in stages if not isinstance(s, FingerprintEncoder)]
        inputs = [*(["__fp"] if cfg.fingerprints else []), *cfg.numerics]
    else:
        folds = Pipeline(stages=stages).fit(folds).transform(folds)
        stages, inputs = [], [models.FEATURES]
    table = folds.select("fold", cfg.label, *inputs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted, report = models.search(
            table, stages, cfg.model_name, cfg.label, trials, "fold", cfg.parallelism, cfg.on_unsupported
        )
    finally:
        table.unpersist()
    best = max(range(len(trials)), key=lambda i: fitted.avgMetrics[i])
    return trials[best], report


def run_experiment(df: DataFrame, cfg: ExperimentConfig) -> ExperimentResult:
    """One run: split, fit features and classifier on the training side, evaluate on the rest."""
    table = src.require_columns(src.normalize_columns(df), _needed(cfg), cfg.run_name).select(*_needed(cfg))
    if cfg.max_rows is not None:
        table = src.row_cap(table, cfg.max_rows, cfg.id_col)
    # the split is decided once and kept: every later pass reads this table
    marked = materialize(hold_out(table, cfg), "split")
    train, test = marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")
    widths = modal_widths(train, cfg.fingerprints) if cfg.fingerprints else {}
    stages = feature_stages(cfg, widths)

    params, trials = dict(cfg.model_params), None
    if cfg.tuning:
        counts = [t["n_components"] for t in _trials(cfg) if "n_components" in t]
        tuned = feature_stages(replace(cfg, svd_components=counts[0]), widths) if counts else stages
        params, trials = _tune(train, cfg, tuned)
    n_components = params.pop("n_components", None)
    if n_components:
        stages = feature_stages(replace(cfg, svd_components=n_components), widths)

    featurizer = Pipeline(stages=stages).fit(train)
    ready = featurizer.transform(train).select(cfg.label, models.FEATURES)
    if cfg.model_name != "logistic_regression":
        width = (cfg.svd_components or sum(widths.values())) + len(cfg.numerics)
        ready = models.spread_to_fit(ready, train.count(), width)
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tail = models.classifier_stages(cfg.model_name, cfg.label, params, cfg.on_unsupported)
        classifier = Pipeline(stages=tail).fit(ready)
    finally:
        ready.unpersist()
    model = PipelineModel([*featurizer.stages, *classifier.stages])

    scored = model.transform(test).select(cfg.id_col, F.col(cfg.label).alias("label"), "prob")
    predictions = materialize(scored, "predictions")
    # decisions of the unwrapped model are made at 0.5
    report = materialize(metrics.evaluation_bundle(predictions, "label", "prob", 0.5), "metrics")
    threshold, curve = 0.5, None
    if cfg.optimize_threshold:
        curve = materialize(metrics.pr_curve(predictions, "label", "prob"), "thresholds")
        threshold = metrics.best_threshold(curve).first()["threshold"]
        model = models.with_threshold(model, threshold)
    run_dir = None
    if cfg.export_dir:
        run_dir = f"{cfg.export_dir.rstrip('/')}/{cfg.run_name}_{time.strftime('%Y%m%d-%H%M%S')}"
        _save(df.sparkSession, run_dir, cfg, widths, model, report, curve, params, trials)
    predictions = metrics.with_decision(predictions, "prob", threshold)
    return ExperimentResult(model, predictions, report, threshold, params, trials, run_dir)


def _save(spark, run_dir, cfg, widths, model, report, curve, params, trials) -> None:
    text = json.dumps({**asdict(cfg), "widths": widths, "best_params": params}, indent=4)
    spark.createDataFrame([(text,)], "value string").write.text(f"{run_dir}/config.json")
    src.write_json(report, f"{run_dir}/test_metrics.json")
    model.write().overwrite().save(f"{run_dir}/model")
    if trials is not None:
        src.write_csv(trials, f"{run_dir}/tuning_results.csv")
    if curve is not None:
        src.write_csv(curve, f"{run_dir}/threshold_optimization/threshold_analysis.csv")
        src.write_json(metrics.best_threshold(curve), f"{run_dir}/threshold_optimization/optimal_threshold_summary.json")
    for stage in model.stages:
        if hasattr(stage, "explained_variance_ratio"):
            src.write_json(variance_table(stage, spark), f"{run_dir}/svd_variance.json")


def load_run(spark: SparkSession, run_dir: str) -> tuple[PipelineModel, dict]:
    """Model and settings of a saved run."""
    text = "\n".join(r["value"] for r in spark.read.text(f"{run_dir}/config.json", wholetext=True).collect())
    return PipelineModel.load(f"{run_dir}/model"), json.loads(text)


def run_sweep(df: DataFrame, base: ExperimentConfig, combinations: list[list[str]]) -> DataFrame:
    """One run per set of fingerprints, and the report over all of them."""
    if not base.export_dir:
        raise ValueError("a sweep needs export_dir")
    wanted = replace(base, fingerprints=sorted({c for combo in combinations for c in combo}))
    table = materialize(src.normalize_columns(df).select(*_needed(wanted)), "sweep")
    for combo in combinations:
        name = f"featsel__{'_'.join(combo)}"
        run_experiment(table, replace(base, run_name=name, fingerprints=combo))
    return sweep_report(src.read_run_metrics(df.sparkSession, base.export_dir, "featsel_*"))


def sweep_report(runs: DataFrame) -> DataFrame:
    """Positive-class metrics per run, best F1 first; a metric that is absent counts as 0."""
    present = runs.columns
    section = lambda f: F.coalesce(F.col("`1`")[f], F.lit(0.0)) if "1" in present else F.lit(0.0)
    auc = F.coalesce("roc_auc_score", F.lit(0.0)) if "roc_auc_score" in present else F.lit(0.0)
    return runs.select(
        features_from_run_name(F.col("run_name")).alias("features_tested"),
        section("precision").alias("precision"),
        section("recall").alias("recall"),
        section("f1-score").alias("f1_score"),
        auc.alias("roc_auc_score"),
    ).orderBy(F.desc("f1_score"), "features_tested")
