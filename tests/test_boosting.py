"""Histogram boosting against a plain version, and the settings of the three boosted kinds."""

import json
import math
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from assaykit.operators import boosting, models
from assaykit.operators.boosting import BoostingSettings, HistogramBoosting


def plain(x, y, w, s, turns):
    """Best-first growth one split at a time, every border of every feature tried."""
    share = (y * w).sum() / w.sum()
    margin = np.full(len(y), math.log(share / (1 - share)))
    for _ in range(turns):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        soft = lambda v: math.copysign(max(abs(v) - s.l1, 0), v)
        score = lambda m: soft(g[m].sum()) ** 2 / (h[m].sum() + s.l2)

        def best(m, depth):
            found = (s.min_gain + 1e-12, None)
            if s.depth and depth >= s.depth:
                return found
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for border in (values[1:] + values[:-1]) / 2:
                    a, b = m & (x[:, f] <= border), m & (x[:, f] > border)
                    if min(a.sum(), b.sum()) >= s.min_rows and min(h[a].sum(), h[b].sum()) >= s.min_hessian and a.any() and b.any():
                        gain = score(a) + score(b) - score(m)
                        if gain > found[0] + 1e-9:
                            found = (gain, (a, b, depth + 1))
            return found

        leaves = [(np.ones(len(y), bool), *best(np.ones(len(y), bool), 0))]
        while len(leaves) < (s.leaves or 10**9):
            at = max(range(len(leaves)), key=lambda i: leaves[i][1] if leaves[i][2] else -1)
            if not leaves[at][2]:
                break
            a, b, depth = leaves.pop(at)[2]
            leaves += [(a, *best(a, depth)), (b, *best(b, depth))]
        for m, *_ in leaves:
            margin[m] -= s.rate * soft(g[m].sum()) / (h[m].sum() + s.l2)
    return margin


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 2, 400), rng.integers(0, 4, 400) * (rng.random(400) < 0.3), rng.normal(size=400).round(1), np.zeros(400)]).astype(float)
    y = (x[:, 0] + x[:, 2] * (x[:, 1] > 0) + rng.normal(scale=0.5, size=400) > 0.6).astype(float)
    return x, y, np.where(y == 1, 3.0, 1.0)


def frame(spark, x, y, w):
    rows = [(i, *map(float, (a, b)), [float(v) for v in r]) for i, (r, a, b) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, "id int, y double, w double, a array<double>")
    return df.repartition(3).withColumn("features", array_to_vector("a"))


def fit(df, s):
    return HistogramBoosting(settings=json.dumps(asdict(s)), labelCol="y", weightCol="w").fit(df)


def margins(model, df):
    rows = model.transform(df).select("id", "rawPrediction", "probability", "prediction").orderBy("id").collect()
    assert all(r.prediction == (r.rawPrediction[1] > 0) and 0 <= r.probability[1] <= 1 for r in rows)
    return np.array([r.rawPrediction[1] for r in rows])


@pytest.mark.parametrize("s", [
    BoostingSettings(trees=3, rate=0.3, leaves=6, l2=1.0),
    BoostingSettings(trees=2, rate=0.5, leaves=None, depth=3, l2=2.0, l1=1.5, min_rows=15, min_hessian=2.0),
])
def test_grows_like_the_plain_version(spark, data, s, monkeypatch):
    monkeypatch.setattr(boosting, "TREES_KEPT", 2)
    df = frame(spark, *data)
    assert margins(fit(df, s), df) == pytest.approx(plain(*data, s, s.trees), abs=1e-6)


def test_sampling_and_noise_repeat_and_still_learn(spark, data):
    df = frame(spark, *data)
    s = BoostingSettings(trees=4, leaves=8, row_share=0.6, column_share=0.75, noise=0.05, l2=1.0)
    first, again = (margins(fit(df, s), df) for _ in range(2))
    assert first == pytest.approx(again) and ((first > np.median(first)) == data[1]).mean() > 0.7


def test_odd_tables(spark, data, tmp_path):
    x, y, w = data
    with pytest.raises(ValueError):
        fit(frame(spark, x[:0], y[:0], w[:0]).limit(0), BoostingSettings(trees=1))
    same = frame(spark, x[:20], np.zeros(20), w[:20])
    assert (margins(fit(same, BoostingSettings(trees=1)), same) < -10).all()
    with pytest.raises(ValueError):
        BoostingSettings(leaves=None, depth=None)
    model = Pipeline(stages=[HistogramBoosting(settings=json.dumps(asdict(BoostingSettings(trees=2))), labelCol="y", weightCol="w")]).fit(frame(spark, *data))
    model.save(str(tmp_path / "m"))
    df = frame(spark, *data).drop("y", "w")
    assert margins(PipelineModel.load(str(tmp_path / "m")), df) == pytest.approx(margins(model, df))


@pytest.mark.parametrize("name, params, want", [
    ("catboost", {"learning_rate": 0.2141837713010419, "depth": 10, "l2_leaf_reg": 1.261357543385574, "random_strength": 0.0005881339039579889},
     {"trees": 1000, "depth": 10, "leaves": None, "l2": 1.261357543385574, "noise": 0.0005881339039579889}),
    ("lightgbm", {"num_leaves": 63, "n_estimators": 200, "reg_alpha": 0.1, "reg_lambda": 2.0, "learning_rate": 0.05}, {"trees": 200, "leaves": 63, "depth": None, "l1": 0.1, "l2": 2.0}),
    ("xgboost", {"learning_rate": 0.1, "max_depth": 7, "n_estimators": 500, "l2_leaf_reg": 4.0}, {"trees": 500, "depth": 7, "l2": 4.0, "min_hessian": 1.0}),
])
def test_shipped_settings_are_taken(name, params, want):
    model = models.make_classifier(name, params)
    got = json.loads(model.getOrDefault(model.settings))
    assert {k: got[k] for k in want} == want and got["rate"] == params["learning_rate"]


def test_boosted_kind_in_a_pipeline(spark, data):
    df = frame(spark, *data).withColumn("label", F.col("y").cast("int")).drop("y", "w")
    stages = models.classifier_stages("lightgbm", "label", {"num_leaves": 5, "n_estimators": 3, "min_child_samples": 5, "reg_lambda": 1.0})
    scored = Pipeline(stages=stages).fit(df).transform(df)
    hits = scored.where("predicted = label").count()
    assert hits > 0.8 * df.count()
