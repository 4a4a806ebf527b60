"""Classifiers by name, class weights, thresholds and parameter search."""

from __future__ import annotations

import itertools
import json
import math
import random
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.boosting import BoostingSettings, HistogramBoosting

FEATURES, LABEL, WEIGHT = "features", "__label", "__weight"
# Feature values, zeros too, that a task keeps while a classifier is fitted, about.
VALUES_PER_TASK = 8_000_000

# Weight of the positive class for the two boosted kinds that do not balance.
POSITIVE_WEIGHT = 12.0
BOOSTED = ("lightgbm", "xgboost", "catboost")
MODEL_NAMES = ("logistic_regression", "random_forest", *BOOSTED)
# Documented defaults of the named model kinds, where Spark's differ.
DEFAULTS = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000, "penalty": "l2"},
    "random_forest": {"n_estimators": 100, "max_features": "sqrt"},
    "lightgbm": {"n_estimators": 100, "learning_rate": 0.1},
    "xgboost": {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 6},
    "catboost": {"n_estimators": 1000, "learning_rate": 0.03, "max_depth": 6},
}
# Settings about threads, logging or solvers, which Spark decides itself.
_IGNORED = {"n_jobs", "thread_count", "verbose", "solver"}
# Settings that the weight column honours.
_WEIGHTS = {"class_weight", "scale_pos_weight"}
# Settings that Spark's boosted trees lack; one of them asks for the histogram booster.
_REGULARISED = {
    "num_leaves": "leaves", "reg_lambda": "l2", "l2_leaf_reg": "l2", "reg_alpha": "l1", "gamma": "min_gain", "min_split_gain": "min_gain",
    "min_child_weight": "min_hessian", "min_child_samples": "min_rows", "subsample": "row_share", "colsample_bytree": "column_share",
    "random_strength": "noise", "max_bin": "bins",
}
# How the three boosted kinds grow and penalise unless told otherwise.
_BOOSTED_DEFAULTS = {
    "lightgbm": {"leaves": 31, "depth": None, "l2": 0.0, "min_hessian": 1e-3, "min_rows": 20},
    "xgboost": {"leaves": None, "depth": 6, "l2": 1.0, "min_hessian": 1.0, "min_rows": 1},
    "catboost": {"leaves": None, "depth": 6, "l2": 3.0, "min_hessian": 0.0, "min_rows": 1},
}
_ALIASES = {"depth": "max_depth", "iterations": "n_estimators"}
# Spark trees stop at this depth: an unset depth of a forest means it, a greater one is an error.
MAX_TREE_DEPTH = 30


class ClassWeighter(Estimator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a weight column: balanced n/(k*n_class), or a fixed weight for positives.

    Fitted as a pipeline stage, so weights come from the training fold only.
    """

    positiveWeight = Param(
        Params._dummy(), "positiveWeight", "fixed weight of positives; 0 balances", TypeConverters.toFloat
    )

    @keyword_only
    def __init__(self, *, labelCol=None, positiveWeight=0.0):
        super().__init__()
        self._setDefault(positiveWeight=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ClassWeighterModel:
        fixed = self.getOrDefault(self.positiveWeight)
        if fixed > 0:
            weights = [1.0, fixed]
        else:
            y = F.col(self.getLabelCol())
            n, n1 = df.agg(F.count("*"), F.sum((y == 1).cast("long"))).first()
            n1 = n1 or 0
            if n1 in (0, n):
                raise ValueError("balanced weights need both classes in the training rows")
            weights = [n / (2.0 * (n - n1)), n / (2.0 * n1)]
        return ClassWeighterModel(labelCol=self.getLabelCol(), weights=weights)


class ClassWeighterModel(Model, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "weight of class 0 and 1", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, labelCol=None, weights=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        label = self.getLabelCol()
        if label not in df.columns:  # rows to be scored have no label and need no weight
            return df
        w0, w1 = self.getOrDefault(self.weights)
        return df.withColumns(
            {LABEL: F.col(label).cast("double"), WEIGHT: F.when(F.col(label) == 1, w1).otherwise(w0)}
        )


class PenalizedLogistic(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Logistic regression with an inverse penalty ``C``: regParam is 1 / (C * sum of weights)."""

    C = Param(Params._dummy(), "C", "inverse of the penalty", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "l1 or l2", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, C=1.0, penalty="l2", maxIter=1000):
        super().__init__()
        self._setDefault(C=1.0, penalty="l2", maxIter=1000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> Model:
        total = df.agg(F.sum(WEIGHT)).first()[0]
        return LogisticRegression(
            featuresCol=FEATURES,
            labelCol=LABEL,
            weightCol=WEIGHT,
            standardization=False,
            regParam=1.0 / (self.getOrDefault(self.C) * total),
            elasticNetParam=1.0 if self.getOrDefault(self.penalty) == "l1" else 0.0,
            maxIter=self.getOrDefault(self.maxIter),
            tol=1e-8,
        ).fit(df)


class ProbabilityThreshold(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Last stage of a fitted model: ``prob`` of the positive class and ``prob >= threshold``."""

    threshold = Param(Params._dummy(), "threshold", "lowest probability called positive", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, threshold=0.5):
        super().__init__()
        self._setDefault(threshold=0.5)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        prob = vector_to_array(F.col("probability"))[1]
        return df.withColumn("prob", prob).withColumn(
            "predicted", (F.col("prob") >= self.getOrDefault(self.threshold)).cast("int")
        )


def make_classifier(name: str, params: dict | None = None, on_unsupported: str = "error") -> Estimator:
    """Classifier by name. A boosted kind with leaves, penalties, sampling or noise set is the histogram
    booster, otherwise Spark's. Parameters that neither has raise, or are left out with ``on_unsupported='ignore'``. A penalty other than l1 and l2, or a depth that Spark's trees can't
    have, always raises. A depth that is not set is ``MAX_TREE_DEPTH`` in a forest and 5 in boosted trees."""
    if name not in MODEL_NAMES:
        raise ValueError(f"model {name!r} not recognized; use one of {MODEL_NAMES}")
    given = {_ALIASES.get(k, k): v for k, v in (params or {}).items() if k not in _IGNORED | _WEIGHTS}
    p = {**DEFAULTS[name], **given}
    if p.get("penalty", "l2") not in ("l1", "l2"):
        raise ValueError(f"{name}: penalty {p['penalty']!r} is not supported; use 'l1' or 'l2'")
    depth = p.get("max_depth")
    if depth is not None and not 1 <= depth <= MAX_TREE_DEPTH:
        raise ValueError(f"{name}: max_depth {depth} is not between 1 and {MAX_TREE_DEPTH}")
    seed = p.pop("random_state", 42)
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "weightCol": WEIGHT, "seed": seed}
    if name == "logistic_regression":
        taken = {"C", "penalty", "max_iter"}
        model = PenalizedLogistic(C=p["C"], penalty=p["penalty"], maxIter=p["max_iter"])
    elif name == "random_forest":
        taken = {"n_estimators", "max_depth", "min_samples_leaf", "max_features"}
        model = RandomForestClassifier(
            numTrees=p["n_estimators"],
            maxDepth=p.get("max_depth") or MAX_TREE_DEPTH,
            minInstancesPerNode=p.get("min_samples_leaf", 1),
            featureSubsetStrategy=str(p["max_features"] or "all"),
            **common,
        )
    elif set(p) & set(_REGULARISED) or p.get("max_depth", 0) is None:
        taken = {"n_estimators", "learning_rate", "max_depth", *_REGULARISED}
        model = HistogramBoosting(
            settings=json.dumps(asdict(boosting_settings(name, p, seed))), featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT
        )
    else:
        taken = {"n_estimators", "learning_rate", "max_depth"}
        model = GBTClassifier(
            maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p.get("max_depth") or 5, **common
        )
    extra = sorted(set(p) - taken)
    if extra and on_unsupported == "error":
        raise ValueError(f"{name}: parameter(s) {extra} have no Spark counterpart; drop them or pass on_unsupported='ignore'")
    return model


def boosting_settings(name: str, params: dict, seed: int = 42) -> BoostingSettings:
    """Settings of the histogram booster for one of the named kinds; unset ones have that kind's defaults."""
    fixed = _BOOSTED_DEFAULTS[name]
    given = {_REGULARISED[k]: v for k, v in params.items() if k in _REGULARISED and v is not None}
    depth = params.get("max_depth") if "max_depth" in params else fixed["depth"]
    return BoostingSettings(**{**fixed, **given, "trees": params["n_estimators"], "rate": params["learning_rate"], "depth": depth, "seed": seed})


def weighting_for(name: str, label: str, params: dict | None = None) -> ClassWeighter:
    """Default weights of a model, or those that ``class_weight`` or ``scale_pos_weight`` ask for."""
    given = params or {}
    fixed = POSITIVE_WEIGHT if name in ("xgboost", "catboost") else 0.0
    if given.get("scale_pos_weight") is not None:
        fixed = float(given["scale_pos_weight"])
        if fixed <= 0:
            raise ValueError("scale_pos_weight must be positive")
    elif "class_weight" in given:
        if given["class_weight"] not in ("balanced", None):
            raise ValueError("class_weight is 'balanced' or None; other weights go into scale_pos_weight")
        fixed = 0.0 if given["class_weight"] else 1.0
    return ClassWeighter(labelCol=label, positiveWeight=fixed)


def classifier_stages(name: str, label: str, params: dict | None = None, on_unsupported: str = "error") -> list:
    """Weights, classifier and the 0.5 decision, to follow the feature stages."""
    return [
        weighting_for(name, label, params),
        make_classifier(name, params, on_unsupported),
        ProbabilityThreshold(threshold=0.5),
    ]


def spread_to_fit(df: DataFrame, n_rows: int, width: int) -> DataFrame:
    """``df`` in tasks of a bounded size for rows of ``width`` features, which a file holds in few bytes.

    Trees keep a number for every feature of a row, so a task that reads one split of a file may keep
    gigabytes. A table that the cores share in smaller parts anyway is returned as it is.
    """
    tasks = -(-n_rows * width // VALUES_PER_TASK)
    return df.repartition(tasks) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def with_threshold(model: PipelineModel, threshold: float) -> PipelineModel:
    """The same fitted model deciding at another threshold."""
    stages = [s for s in model.stages if not isinstance(s, ProbabilityThreshold)]
    return PipelineModel([*stages, ProbabilityThreshold(threshold=float(threshold))])


def parameter_grid(space: dict[str, list]) -> list[dict]:
    """Every combination of the listed values."""
    names = list(space)
    return [dict(zip(names, combo)) for combo in itertools.product(*space.values())]


def sampled_parameters(space: dict[str, list], n_trials: int, seed: int = 42) -> list[dict]:
    """Seeded draws from ``['int', lo, hi]``, ``['float', lo, hi(, 'log')]`` or ``['categorical', values]``."""
    rng = random.Random(seed)

    def draw(spec):
        kind = spec[0]
        if kind == "int":
            return rng.randint(spec[1], spec[2])
        if kind == "categorical":
            return rng.choice(spec[1])
        if kind != "float":
            raise ValueError(f"unknown parameter kind {kind!r}")
        if len(spec) == 4 and spec[3] == "log":
            return math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
        return rng.uniform(spec[1], spec[2])

    return [{name: draw(spec) for name, spec in space.items()} for _ in range(n_trials)]


def search(
    df: DataFrame,
    feature_stages: list,
    model_name: str,
    label: str,
    trials: list[dict],
    fold: str,
    parallelism: int = 2,
    on_unsupported: str = "error",
) -> tuple[CrossValidatorModel, DataFrame]:
    """Cross-validate parameter sets on given folds, refit the best, and return all trials.

    Keys of a trial that a feature stage owns (``n_components``) set that stage; the rest go to
    the classifier. The score is the support-weighted F1 averaged over the folds.
    """
    decision = ProbabilityThreshold(threshold=0.5)
    whole = Pipeline()
    maps = []
    for trial in trials:
        owned, rest = {}, dict(trial)
        if "n_components" in rest:
            owned["k"] = rest.pop("n_components")
            if not any(s.hasParam("k") for s in feature_stages):
                raise ValueError("n_components is tuned, but no feature stage has components")
        stages = [
            s.copy({s.k: owned["k"]}) if owned and s.hasParam("k") else s for s in feature_stages
        ]
        classifier = make_classifier(model_name, rest, on_unsupported)
        maps.append({whole.stages: [*stages, weighting_for(model_name, label, rest), classifier, decision]})
    n_folds = df.agg(F.max(fold)).first()[0] + 1
    labelled = df.withColumn(LABEL, F.col(label).cast("double"))
    validator = CrossValidator(
        estimator=whole.setStages(maps[0][whole.stages]),
        estimatorParamMaps=maps,
        evaluator=MulticlassClassificationEvaluator(
            labelCol=LABEL, predictionCol="prediction", metricName="f1"
        ),
        numFolds=int(n_folds),
        foldCol=fold,
        parallelism=parallelism,
    )
    fitted = validator.fit(labelled)
    rows = [(i, str(sorted(t.items())), float(m)) for i, (t, m) in enumerate(zip(trials, fitted.avgMetrics))]
    table = df.sparkSession.createDataFrame(rows, "trial int, params string, f1_weighted double")
    return fitted, table
