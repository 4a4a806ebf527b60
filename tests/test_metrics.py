import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assaykit.operators import metrics, ordered, profile


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(3)
    n = 400
    return pd.DataFrame({"id": np.arange(n), "y": (rng.random(n) < 0.3).astype(int), "s": np.round(rng.random(n), 2)})


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size


def test_auc_with_ties(spark, scored):
    df = spark.createDataFrame(scored)
    got = metrics.roc_auc(df, "y", "s").first()[0]
    assert got == pytest.approx(brute_auc(scored.y.to_numpy(), scored.s.to_numpy()), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] is None


def test_auc_does_not_depend_on_row_order_or_partitions(spark, scored):
    df = spark.createDataFrame(scored)
    mixed = spark.createDataFrame(scored.sample(frac=1, random_state=1)).repartition(13)
    assert metrics.roc_auc(df, "y", "s").first() == metrics.roc_auc(mixed, "y", "s").first()


def test_skewed_scores(spark):
    """A third of the rows share one score."""
    df = spark.range(3000).select(
        (F.col("id") % 4 == 0).cast("int").alias("y"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") % 701) / 701).alias("s"),
    )
    p = df.toPandas()
    got = metrics.roc_auc(df, "y", "s").first()[0]
    assert got == pytest.approx(brute_auc(p.y.to_numpy(), p.s.to_numpy()), abs=1e-12)


def test_nan_score_is_an_error(spark):
    df = spark.createDataFrame([(1, float("nan")), (0, 0.2)], "y int, s double")
    with pytest.raises(PySparkException, match="NaN"):
        metrics.roc_auc(df, "y", "s").collect()


def test_pr_curve_and_best_threshold(spark, scored):
    df = spark.createDataFrame(scored)
    curve = metrics.pr_curve(df, "y", "s")
    for r in curve.orderBy("threshold").limit(20).collect():
        hit = scored.s >= r["threshold"]
        tp = (hit & (scored.y == 1)).sum()
        assert r["precision"] == pytest.approx(tp / hit.sum()) and r["recall"] == pytest.approx(tp / scored.y.sum())
    best = metrics.best_threshold(curve).first()
    top = curve.agg(F.max("f1_score")).first()[0]
    assert best["f1_score"] == top
    assert best["threshold"] == curve.where(F.col("f1_score") == top).agg(F.min("threshold")).first()[0]


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "y int, s double")
    assert tuple(metrics.threshold_metrics(df, "y", "s", 0.9).first()) == (0.0, 0.0, 0.0)


def test_confusion_matrix_has_empty_cells(spark):
    df = spark.createDataFrame([(1, 1)], "y int, p int")
    got = {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_roc_corners_keep_the_curve(spark, scored):
    df = spark.createDataFrame(scored)
    area = lambda pts: np.trapezoid([0, *[p["tpr"] for p in pts]], [0, *[p["fpr"] for p in pts]])
    full = metrics.roc_points(df, "y", "s").orderBy(F.desc("threshold")).collect()
    kept = metrics.roc_points(df, "y", "s", drop_collinear=True).orderBy(F.desc("threshold")).collect()
    assert len(kept) <= len(full) and area(kept) == pytest.approx(area(full))


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.85, 1.0])
def test_exact_quantile_matches_numpy(spark, q):
    values = np.random.default_rng(5).normal(size=501)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(7)
    got = ordered.exact_quantiles(df, "v", {"x": q}).first()["x"]
    assert got == pytest.approx(np.percentile(values, q * 100), abs=1e-12)


def test_quantile_of_column_named_like_helpers(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "n long")
    assert ordered.exact_quantiles(df, "n", {"m": 0.5}).first()["m"] == 2.0


def test_describe_handles_nan_null_and_constant(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0), (float("nan"), 5.0), (None, 5.0), (3.0, 5.0)], "a double, b double"
    )
    got = {r["column"]: r for r in profile.describe_numeric(df).collect()}
    assert (got["a"]["count"], got["a"]["mean"], got["a"]["q50"]) == (2, 2.0, 2.0)
    assert (got["b"]["std"], got["b"]["q25"], got["b"]["max"]) == (0.0, 5.0, 5.0)
    nulls = {r["column"]: r["nulls"] for r in profile.column_nulls(df).collect()}
    assert nulls == {"a": 2, "b": 0}


def test_hit_rate_of_empty_table(spark):
    df = spark.createDataFrame([], "predicted int")
    assert tuple(profile.hit_rate(df, label="predicted").first()) == (0, 0, 0.0)
    with pytest.raises(ValueError):
        profile.hit_rate(df)


def test_histogram_of_equal_sizes(spark):
    df = spark.range(6).select((F.col("id") % 3).alias("cluster_id"))
    rows = profile.cluster_histogram(df).collect()
    assert len(rows) == 1 and rows[0]["clusters"] == 3


def test_ranks_are_a_permutation(spark):
    df = spark.range(1000).select("id", F.xxhash64("id").alias("h")).repartition(9)
    rows = ordered.global_rank(df, ["h"]).orderBy("h").collect()
    assert [r["rank"] for r in rows] == list(range(1, 1001))


def test_rank_within_big_group(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 9).otherwise(-1).alias("g"))
    p = df.toPandas().sort_values(["g", "id"])
    p["want"] = p.groupby("g").cumcount() + 1
    got = {r["id"]: r["rank"] for r in ordered.rank_within(df, ["g"], ["id"]).collect()}
    assert got == dict(zip(p.id, p.want))


def test_running_totals_and_next(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id", (F.col("id") + 1).alias("v")).repartition(5)
    out = ordered.running_totals(df, ["g"], ["id"], ["v"], following=["v"]).toPandas().sort_values(["g", "id"])
    p = df.toPandas().sort_values(["g", "id"])
    assert (out.cum_v.to_numpy() == p.groupby("g").v.cumsum().to_numpy()).all()
    want = p.groupby("g").v.shift(-1).to_numpy()
    assert np.array_equal(out.next_v.to_numpy(dtype=float), want, equal_nan=True)


def test_roc_starts_at_the_origin_and_keeps_the_highest_score(spark):
    rows = list(zip([1, 1, 0, 1, 0], [0.9, 0.8, 0.7, 0.6, 0.5]))
    df = spark.createDataFrame(rows, "y int, s double")
    full = sorted((r.threshold, r.fpr, round(r.tpr, 6)) for r in metrics.roc_points(df, "y", "s").collect())
    assert full == [(0.5, 1.0, 1.0), (0.6, 0.5, 1.0), (0.7, 0.5, 0.666667), (0.8, 0.0, 0.666667), (0.9, 0.0, 0.333333), (float("inf"), 0.0, 0.0)]
    corners = sorted(r.threshold for r in metrics.roc_points(df, "y", "s", drop_collinear=True).collect())
    assert corners == [0.5, 0.6, 0.7, 0.8, 0.9, float("inf")]
    assert metrics.roc_points(df.limit(0), "y", "s").count() == 0
