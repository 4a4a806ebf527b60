import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assaykit.operators import joins, splits
from assaykit.plans import fixtures as fx


@pytest.fixture(scope="module")
def labels(spark, small):
    return fx.labels(spark, small).cache()


def plain_greedy(groups, k):
    """Rows of (positives, negatives) per fold, one left-over group at a time, straight from the rule."""
    y1, y0 = (sum(g[i] for g in groups) for i in (0, 1))
    load = [[0, 0] for _ in range(k)]
    even = [0, 0]
    for (a, b), c in sorted(Counter(groups).items(), key=lambda g: (-sum(g[0]), -g[0][0])):
        even = [even[0] + a * (c // k), even[1] + b * (c // k)]
        for _ in range(c % k):
            f = min(range(k), key=lambda i: (Fraction(load[i][0] * a, max(y1, 1) ** 2) + Fraction(load[i][1] * b, max(y0, 1) ** 2), sum(load[i])))
            load[f] = [load[f][0] + a, load[f][1] + b]
    return sorted((a + even[0], b + even[1]) for a, b in load)


def loads(out, k):
    got = {r["fold"]: (r["p"], r["n"] - r["p"]) for r in out.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()}
    return [got.get(f, (0, 0)) for f in range(k)]


def test_groups_stay_whole_and_folds_are_even(labels):
    out = splits.stratified_group_folds(labels, "group_id", "label", 5).cache()
    assert out.count() == labels.count()
    assert out.groupBy("group_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    got = loads(out, 5)
    rows = [a + b for a, b in got]
    assert max(rows) - min(rows) <= 0.02 * sum(rows) and max(a for a, _ in got) - min(a for a, _ in got) <= 2
    groups = labels.groupBy("group_id").agg(F.sum("label").alias("a"), F.count("*").alias("n")).collect()
    assert sorted(got) == plain_greedy([(r["a"], r["n"] - r["a"]) for r in groups], 5)


@pytest.mark.parametrize("per_block", [50_000, 50])
def test_heavy_tailed_groups(spark, monkeypatch, per_block):
    """Sizes as 1 / rank: the largest group alone is more than a fold, the others are evened out."""
    monkeypatch.setattr(splits, "PROFILES_PER_BLOCK", per_block)
    rng = random.Random(1)
    groups = [(rng.randrange(size // 2 + 1), size) for size in (max(1, 4000 // (r + 1)) for r in range(500))]
    rows = [(g, int(i < a)) for g, (a, n) in enumerate(groups) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, label int").repartition(6)
    out = splits.stratified_group_folds(df, "g", "label", 5)
    got = loads(out, 5)
    assert sorted(got) == plain_greedy([(a, n - a) for a, n in groups], 5)
    share = [(a + b) / len(rows) for a, b in got]
    assert abs(share[0] - 0.2) < 0.02  # the hold-out has the size asked for
    assert out.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_balanced_folds_are_as_even_as_the_largest_first_rule(spark):
    sizes = [900, 400, 350, 300, 120, 60, 60, 60, *[7] * 50, *[1] * 33]
    df = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "g int").withColumn("label", F.lit(0))
    got = loads(splits.balanced_group_folds(df, "g", 4), 4)
    assert sorted(n for _, n in got) == [n for _, n in plain_greedy([(0, n) for n in sizes], 4)]


def test_folds_of_odd_tables(spark):
    empty = spark.createDataFrame([], "g int, label int")
    assert splits.stratified_group_folds(empty, "g", "label", 3).count() == 0
    few = spark.createDataFrame([(1, 1), (1, None), (2, None)], "g int, label int")
    out = splits.stratified_group_folds(few, "g", "label", 5)
    assert out.count() == 3 and out.select("fold").distinct().count() == 2
    with pytest.raises(ValueError):
        splits.stratified_group_folds(few, "g", "label", 1)


def test_same_seed_same_split_other_seed_other_split(labels):
    key = lambda s, df: {(r[0], r[1]) for r in splits.stratified_group_folds(df, "group_id", "label", 5, s).select("compound_id", "fold").collect()}
    assert key(1, labels) == key(1, labels.repartition(11))
    assert key(1, labels) != key(2, labels)


def test_hot_group(spark):
    """One group holds a third of all rows and is still assigned once."""
    df = spark.range(3000).select(
        "id", (F.col("id") % 5 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("g"),
    )
    out = splits.stratified_group_folds(df, "g", "label", 4)
    assert out.count() == 3000
    assert out.where("g = 0").select("fold").distinct().count() == 1


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, 0), (3, "a", 0), (4, "b", 1)], "id int, g string, label int")
    out = splits.balanced_group_folds(df, "g", 2)
    assert out.count() == 4 and out.where("g IS NULL").select("fold").distinct().count() == 1


def test_halves_are_even_per_class(labels):
    out = splits.stratified_halves(labels, "compound_id", "label")
    for r in out.groupBy("label").pivot("half", [0, 1]).count().collect():
        assert 0 <= r["0"] - r["1"] <= 1


def test_adversarial_split_takes_ties(spark):
    df = spark.createDataFrame([(i, 1.0 if i >= 5 else 0.0) for i in range(10)], "id int, s double")
    assert splits.adversarial_split(df, "s", 0.1).where("is_test").count() == 5


def test_adversarial_split_rejects_nan(spark):
    df = spark.createDataFrame([(0.1,), (float("nan"),)], "s double")
    with pytest.raises(PySparkException, match="NaN"):
        splits.adversarial_split(df, "s", 0.5).collect()


def test_row_selection_none_and_empty(spark):
    df = spark.range(5).withColumnRenamed("id", "row_id")
    assert joins.only_rows(df, None).count() == 5
    assert joins.only_rows(df, df.limit(0)).count() == 0


def test_attach_by_key_spreads_hot_keys(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    lookup = rows.groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("top"))
    out = joins.attach_by_key(rows, lookup, "k", "w", ["top"])
    assert out.columns == ["id", "k", "top"] and out.count() == 9000
    assert out.where("k = 0").agg(F.countDistinct("top")).first()[0] == 1


def test_expert_matrix_keeps_rows_missing_in_one_model(spark):
    long = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.3)], "row_id int, model string, prob double")
    got = {r["row_id"]: (r["a"], r["b"]) for r in joins.expert_matrix(long, ["a", "b"]).collect()}
    assert got == {1: (0.1, 0.2), 2: (0.3, None)}


def test_a_key_with_half_of_the_rows_is_spread_over_copies_by_its_size(spark, monkeypatch):
    rows = spark.range(4000).withColumn("k", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    for most in (1_000_000, 3):
        monkeypatch.setattr(joins, "ROWS_PER_COPY", most)
        got = joins.attach_by_key(rows, lookup, "k", "n", ["v"])
        assert got.columns == ["id", "k", "v"]
        assert got.count() == 4000 and got.where("v != 2 * k or v is null").count() == 0
