"""Exact classification metrics as distributed aggregates.

Everything starts from counts per distinct score, so rows are combined before any shuffle and
ties are handled exactly. ``groups`` lets one job evaluate several models at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.scalars import f1_score, safe_ratio
from assaykit.operators.ordered import running_totals


def score_counts(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    positive = (F.col(label) == 1).cast("long")
    return df.groupBy(*(groups or []), F.col(score).cast("double").alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def score_curve(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Cumulative true and false positives by descending score, with totals per group.

    ``next_pos`` and ``next_neg`` are the counts at the next lower score. A null or NaN score has
    no place in the order and is an error, not a low score.
    """
    groups = groups or []
    s = F.col(score).cast("double")
    checked = df.withColumn(
        score, F.when(s.isNull() | F.isnan(s), F.raise_error(F.lit("null or NaN score"))).otherwise(s)
    )
    counts = score_counts(checked, label, score, groups)
    both = ["pos", "neg"]
    return running_totals(counts, groups, [F.desc("score")], both, following=both).select(
        *groups,
        "score",
        "pos",
        "neg",
        "next_pos",
        "next_neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.col("total_pos").alias("positives"),
        F.col("total_neg").alias("negatives"),
    )


def auc_from_curve(curve: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Mann-Whitney statistic: each positive beats the negatives scored below it, half the tied."""
    below = F.col("negatives") - F.col("fp")
    wins = F.col("pos").cast("double") * (below + 0.5 * F.col("neg"))
    pairs = F.max("positives").cast("double") * F.max("negatives")
    return curve.groupBy(*(groups or [])).agg(F.when(pairs > 0, F.sum(wins) / pairs).alias("roc_auc"))


def roc_auc(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    return auc_from_curve(score_curve(df, label, score, groups), groups)


def roc_points(df: DataFrame, label: str, score: str, drop_collinear: bool = False) -> DataFrame:
    """False and true positive rate from the origin, at threshold infinity, over every distinct score.

    ``drop_collinear`` keeps only corner points of the curve: a point goes when the step to it
    and the step after it add the same number of positives and the same number of negatives. The
    point of the highest score always stays. An empty table has no points.
    """
    curve = score_curve(df, label, score)
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    if drop_collinear:
        same_step = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
        curve = curve.where(first | ~F.coalesce(same_step, F.lit(False)))
    point = F.struct(
        F.col("score").cast("double").alias("threshold"),
        safe_ratio(F.col("fp"), F.col("negatives")).alias("fpr"),
        safe_ratio(F.col("tp"), F.col("positives")).alias("tpr"),
    )
    origin = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.select(F.explode(F.when(first, F.array(origin, point)).otherwise(F.array(point))).alias("p")).select("p.*")


def pr_points(curve: DataFrame, groups: list[str] | None = None) -> DataFrame:
    tp, fp = F.col("tp"), F.col("fp")
    recall = F.when(F.col("positives") > 0, tp / F.col("positives")).otherwise(1.0)
    points = curve.select(
        *(groups or []),
        F.col("score").alias("threshold"),
        safe_ratio(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
    )
    return points.withColumn("f1_score", f1_score(F.col("precision"), F.col("recall")))


def pr_curve(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 at every distinct score used as threshold."""
    return pr_points(score_curve(df, label, score, groups), groups)


def best_threshold(curve: DataFrame) -> DataFrame:
    """Row of a ``pr_curve`` with the highest F1; the lowest threshold wins a tie."""
    return curve.orderBy(F.desc("f1_score"), "threshold").limit(1)


def with_decision(df: DataFrame, score: str, threshold: float, name: str = "predicted") -> DataFrame:
    return df.withColumn(name, (F.col(score) >= F.lit(float(threshold))).cast("int"))


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts of all four (actual, predicted) cells, zeros included, from one aggregate row."""
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    hit = lambda a, p: F.coalesce(
        F.sum(((F.col(label) == a) & (F.col(predicted) == p)).cast("long")), F.lit(0)
    )
    row = df.agg(*[hit(a, p).alias(f"n{a}{p}") for a, p in cells])
    return row.select(
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{a}{p}").alias("n")) for a, p in cells])
        ).alias("c")
    ).select("c.*")


def _outcome_sums(label: str, predicted: Column) -> list[Column]:
    y = F.col(label)
    cell = lambda a, p: F.coalesce(F.sum(((y == a) & (predicted == p)).cast("long")), F.lit(0))
    return [
        cell(1, 1).alias("tp"),
        cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"),
        cell(0, 0).alias("tn"),
    ]


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5, groups: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of the positive class at one threshold, 0 on zero division."""
    groups = groups or []
    predicted = (F.col(score) >= F.lit(float(threshold))).cast("int")
    sums = df.groupBy(*groups).agg(*_outcome_sums(label, predicted))
    p = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(*groups, p.alias("precision"), r.alias("recall")).withColumn(
        "f1_score", f1_score(F.col("precision"), F.col("recall"))
    )


def _report_structs() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    part = {}
    for name, hit, wrong, missed in (("0", tn, fn, fp), ("1", tp, fp, fn)):
        p, r = safe_ratio(hit, hit + wrong), safe_ratio(hit, hit + missed)
        part[name] = (p, r, f1_score(p, r), hit + missed)
    n0, n1 = part["0"][3], part["1"][3]
    mean = lambda i: (part["0"][i] + part["1"][i]) / 2
    weighted = lambda i: safe_ratio(part["0"][i] * n0 + part["1"][i] * n1, n0 + n1)
    part["macro avg"] = (mean(0), mean(1), mean(2), n0 + n1)
    part["weighted avg"] = (weighted(0), weighted(1), weighted(2), n0 + n1)
    structs = {
        k: F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1-score"), s.alias("support"))
        for k, (p, r, f, s) in part.items()
    }
    structs["accuracy"] = safe_ratio(tp + tn, n0 + n1)
    return structs


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row per class and average; the accuracy row repeats its value in every column."""
    s = _report_structs()
    sums = df.agg(*_outcome_sums(label, F.col(predicted)))
    acc = s["accuracy"]
    support = s["macro avg"]["support"]
    s["accuracy"] = F.struct(
        acc.alias("precision"), acc.alias("recall"), acc.alias("f1-score"), support.alias("support")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("class"),
                v["precision"].alias("precision"),
                v["recall"].alias("recall"),
                v["f1-score"].alias("f1_score"),
                v["support"].alias("support"),
            )
            for k, v in s.items()
        ]
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def evaluation_bundle(df: DataFrame, label: str, score: str, threshold: float = 0.5, groups: list[str] | None = None) -> DataFrame:
    """The metrics document of a run, one row per group: report per class, averages and AUC."""
    groups = groups or []
    predicted = (F.col(score) >= F.lit(float(threshold))).cast("int")
    report = df.groupBy(*groups).agg(*_outcome_sums(label, predicted)).select(
        *groups, *[v.alias(k) for k, v in _report_structs().items()]
    )
    auc = roc_auc(df, label, score, groups).withColumnRenamed("roc_auc", "roc_auc_score")
    return report.join(auc, groups) if groups else report.join(auc, F.lit(True))


def weighted_f1(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """F1 averaged over the classes by their support, the score used for tuning."""
    sums = df.agg(*_outcome_sums(label, F.col(predicted)))
    return sums.select(_report_structs()["weighted avg"]["f1-score"].alias("f1_weighted"))


def model_comparison(long: DataFrame, label: str, score: str, model: str = "model", threshold: float = 0.5) -> DataFrame:
    """AUC, precision, recall and F1 of every model in a long score table, best AUC first."""
    at_cut = threshold_metrics(long, label, score, threshold, [model])
    return at_cut.join(roc_auc(long, label, score, [model]), model).orderBy(F.desc("roc_auc"), model)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_class) per class, over a handful of class rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    weight = F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))


def uncertainty_stats(df: DataFrame, col: str = "uncertainty") -> DataFrame:
    return df.agg(
        F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max")
    )
