"""Queries over metrics, splits, joins, ensembles and run reports."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from assaykit.functions.scalars import features_from_run_name
from assaykit.operators import ensemble, features, joins, metrics, profile, splits
from assaykit.operators.models import ProbabilityThreshold
from assaykit.plans import experiment
from assaykit.plans import fixtures as fx
from assaykit.plans import sql
from assaykit.plans.catalog import query, rounded
from assaykit.session import scratch_path
from assaykit.sources import tables as src

LONG = f"WITH {sql.EXPERTS_LONG} "
WIDE = f"WITH {sql.EXPERTS} "
CURVE = f"WITH {sql.CURVE} "

# Outcome counts of expert a at 0.5, and the report built on them.
_REPORT = f"""WITH {sql.EXPERTS_LONG},
o AS (SELECT model, CAST(SUM(CAST(label = 1 AND prob >= 0.5 AS INT)) AS DOUBLE) AS tp, CAST(SUM(CAST(label = 0 AND prob >= 0.5 AS INT)) AS DOUBLE) AS fp,
  CAST(SUM(CAST(label = 1 AND prob < 0.5 AS INT)) AS DOUBLE) AS fn, CAST(SUM(CAST(label = 0 AND prob < 0.5 AS INT)) AS DOUBLE) AS tn FROM long GROUP BY model),
k AS (
  SELECT model, '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS support FROM o
  UNION ALL SELECT model, '1', tp / (tp + fp), tp / (tp + fn), tp + fn FROM o),
f AS (SELECT *, 2 * p * r / (p + r) AS f1 FROM k),
rep AS (
  SELECT model, class, p, r, f1, support FROM f
  UNION ALL SELECT model, 'macro avg', AVG(p), AVG(r), AVG(f1), SUM(support) FROM f GROUP BY model
  UNION ALL SELECT model, 'weighted avg', SUM(p * support) / SUM(support), SUM(r * support) / SUM(support), SUM(f1 * support) / SUM(support), SUM(support) FROM f GROUP BY model
  UNION ALL SELECT model, 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM o)"""

_AUC = """auc AS (
  SELECT model, SUM(pos * (n - fp + 0.5 * neg)) / (MAX(p) * MAX(n)) AS roc_auc FROM (
    SELECT model, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
      CAST(SUM(neg) OVER (PARTITION BY model ORDER BY prob DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fp,
      CAST(SUM(pos) OVER (PARTITION BY model) AS DOUBLE) AS p, CAST(SUM(neg) OVER (PARTITION BY model) AS DOUBLE) AS n
    FROM (SELECT model, prob, SUM(label) AS pos, SUM(1 - label) AS neg FROM long GROUP BY 1, 2)) GROUP BY model)"""


@query(
    "hit_rate",
    WIDE + """SELECT COUNT(*) AS total, CAST(SUM(CAST(a >= 0.5 AS INT)) AS BIGINT) AS hits,
    ROUND(SUM(CAST(a >= 0.5 AS INT)) * 100.0 / COUNT(*), 6) AS hit_rate FROM scores""",
)
def hit_rate(spark, sf):
    return rounded(profile.hit_rate(fx.expert_scores(spark, sf), probability="a", threshold=0.5), "hit_rate")


@query(
    "threshold_metrics",
    _REPORT + """ SELECT model, ROUND(p, 6) AS "precision", ROUND(r, 6) AS recall, ROUND(f1, 6) AS f1_score FROM rep WHERE class = '1'""",
)
def threshold_metrics(spark, sf):
    long = fx.expert_scores_long(spark, sf)
    return rounded(
        metrics.threshold_metrics(long, "label", "prob", 0.5, ["model"]), "precision", "recall", "f1_score"
    )


@query("threshold_labels", WIDE + "SELECT compound_id, a AS prob, CAST(a >= 0.42 AS INT) AS predicted FROM scores")
def threshold_labels(spark, sf):
    # a pipeline's probability column is the vector (1 - p, p)
    scored = fx.expert_scores(spark, sf).withColumn("probability", array_to_vector(F.array(1 - F.col("a"), F.col("a"))))
    return ProbabilityThreshold(threshold=0.42).transform(scored).select("compound_id", "prob", "predicted")


@query(
    "confusion_matrix",
    WIDE + """SELECT g.actual, g.predicted, (SELECT COUNT(*) FROM scores WHERE label = g.actual AND CAST(a >= 0.5 AS INT) = g.predicted) AS n
    FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(actual, predicted)""",
)
def confusion_matrix(spark, sf):
    decided = metrics.with_decision(fx.expert_scores(spark, sf), "a", 0.5)
    return metrics.confusion_matrix(decided, "label", "predicted")


@query(
    "classification_report",
    _REPORT + """ SELECT class, ROUND(p, 6) AS "precision", ROUND(r, 6) AS recall, ROUND(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM rep WHERE model = 'a'""",
)
def classification_report(spark, sf):
    decided = metrics.with_decision(fx.expert_scores(spark, sf), "a", 0.5)
    return rounded(
        metrics.classification_report(decided, "label", "predicted"), "precision", "recall", "f1_score"
    )


@query(
    "evaluation_bundle",
    _REPORT + f""", {_AUC}
    SELECT model, ROUND(MAX(CASE WHEN class = '1' THEN p END), 6) AS precision_1, ROUND(MAX(CASE WHEN class = '0' THEN r END), 6) AS recall_0,
      ROUND(MAX(CASE WHEN class = 'macro avg' THEN f1 END), 6) AS f1_macro, ROUND(MAX(CASE WHEN class = 'weighted avg' THEN f1 END), 6) AS f1_weighted,
      ROUND(MAX(CASE WHEN class = 'accuracy' THEN p END), 6) AS accuracy, CAST(MAX(CASE WHEN class = '1' THEN support END) AS BIGINT) AS support_1,
      ROUND(MAX(roc_auc), 6) AS roc_auc_score
    FROM rep JOIN auc USING (model) GROUP BY model""",
)
def evaluation_bundle(spark, sf):
    """Written as one JSON document per model and read back."""
    path = scratch_path(spark, "metrics")
    bundle = metrics.evaluation_bundle(fx.expert_scores_long(spark, sf), "label", "prob", 0.5, ["model"])
    src.write_json(bundle, path)
    doc = spark.read.schema(bundle.schema).json(path)
    part = lambda section, field: F.col(f"`{section}`")[field]
    out = doc.select(
        "model",
        part("1", "precision").alias("precision_1"),
        part("0", "recall").alias("recall_0"),
        part("macro avg", "f1-score").alias("f1_macro"),
        part("weighted avg", "f1-score").alias("f1_weighted"),
        "accuracy",
        part("1", "support").alias("support_1"),
        "roc_auc_score",
    )
    return rounded(out, "precision_1", "recall_0", "f1_macro", "f1_weighted", "accuracy", "roc_auc_score")


@query("f1_weighted", _REPORT + " SELECT ROUND(f1, 6) AS f1_weighted FROM rep WHERE model = 'b' AND class = 'weighted avg'")
def f1_weighted(spark, sf):
    decided = metrics.with_decision(fx.expert_scores(spark, sf), "b", 0.5)
    return rounded(metrics.weighted_f1(decided, "label", "predicted"), "f1_weighted")


@query("roc_auc", LONG + f", {_AUC} SELECT model, ROUND(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(fx.expert_scores_long(spark, sf), "label", "prob", ["model"]), "roc_auc")


_ROC = CURVE + "SELECT CAST('Infinity' AS DOUBLE) AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr UNION ALL SELECT score AS threshold, ROUND(fp / negatives, 6) AS fpr, ROUND(tp / positives, 6) AS tpr FROM curve"


@query("roc_points", _ROC)
def roc_points(spark, sf):
    return rounded(metrics.roc_points(fx.expert_scores(spark, sf), "label", "a"), "fpr", "tpr")


@query("roc_corners", _ROC + " WHERE (tp = pos AND fp = neg) OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg")
def roc_corners(spark, sf):
    points = metrics.roc_points(fx.expert_scores(spark, sf), "label", "a", drop_collinear=True)
    return rounded(points, "fpr", "tpr")


_PR = 'SELECT threshold, ROUND("precision", 6) AS "precision", ROUND(recall, 6) AS recall, ROUND(f1_score, 6) AS f1_score FROM pr'


@query("pr_curve", CURVE + _PR)
def pr_curve(spark, sf):
    """Threshold analysis as written to CSV."""
    path = scratch_path(spark, "thresholds")
    curve = rounded(metrics.pr_curve(fx.expert_scores(spark, sf), "label", "a"), "precision", "recall", "f1_score")
    src.write_csv(curve, path)
    return src.read_csv(spark, path, curve.schema)


@query("best_threshold", CURVE + _PR + " ORDER BY pr.f1_score DESC, threshold LIMIT 1")
def best_threshold(spark, sf):
    curve = metrics.pr_curve(fx.expert_scores(spark, sf), "label", "a")
    return rounded(metrics.best_threshold(curve), "precision", "recall", "f1_score")


@query(
    "model_comparison",
    _REPORT + f""", {_AUC} SELECT model, ROUND(p, 6) AS "precision", ROUND(r, 6) AS recall, ROUND(f1, 6) AS f1_score, ROUND(roc_auc, 6) AS roc_auc
    FROM rep JOIN auc USING (model) WHERE class = '1'""",
)
def model_comparison(spark, sf):
    table = metrics.model_comparison(fx.expert_scores_long(spark, sf), "label", "prob")
    return rounded(table, "precision", "recall", "f1_score", "roc_auc")


@query(
    "common_models",
    LONG + """, t AS (SELECT model, COUNT(*) AS n FROM long WHERE prob IS NOT NULL GROUP BY 1),
    u AS (SELECT model, COUNT(*) AS n FROM long WHERE model <> 'c' OR prob >= 0.1 GROUP BY 1)
    SELECT model FROM t WHERE n = (SELECT COUNT(*) FROM scores) INTERSECT SELECT model FROM u WHERE n = (SELECT COUNT(*) FROM scores)""",
)
def common_models(spark, sf):
    """An expert that failed on some rows of one side (c) is not common to both."""
    long = fx.expert_scores_long(spark, sf)
    n = fx.table(spark, sf, "orders").count()
    partial = long.where("model <> 'c' OR prob >= 0.1")
    return joins.common_models(joins.complete_models(long, n), joins.complete_models(partial, n))


@query("class_weights", f"""WITH {sql.LABELS} SELECT label, COUNT(*) AS n, ROUND(SUM(COUNT(*)) OVER () / (2.0 * COUNT(*)), 6) AS weight FROM labels_ GROUP BY label""")
def class_weights(spark, sf):
    return rounded(metrics.class_weights(fx.labels(spark, sf), "label"), "weight")


@query(
    "scale_numeric",
    """SELECT o_orderkey, ROUND((o_totalprice - AVG(o_totalprice) OVER ()) / STDDEV_POP(o_totalprice) OVER (), 6) AS o_totalprice_scaled,
    ROUND((o_custkey - AVG(o_custkey) OVER ()) / STDDEV_POP(o_custkey) OVER (), 6) AS o_custkey_scaled FROM orders""",
)
def scale_numeric(spark, sf):
    scaled = features.scale_columns(fx.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    out = scaled.select("o_orderkey", "o_totalprice_scaled", "o_custkey_scaled")
    return rounded(out, "o_totalprice_scaled", "o_custkey_scaled")


@query(
    "stratified_group_folds",
    f"""WITH RECURSIVE {sql.LABELS}, {sql.group_folds("f", "labels_", "group_id", "label", 5)}
    SELECT compound_id, group_id, label, fold FROM labels_ JOIN f USING (group_id)""",
)
def stratified_group_folds(spark, sf):
    return splits.stratified_group_folds(fx.labels(spark, sf), "group_id", "label", splits.fold_count(0.2))


@query(
    "stratified_cv_folds",
    f"""WITH RECURSIVE {sql.LABELS}, {sql.group_folds("h", "labels_", "group_id", "label", 5)},
    train_ AS (SELECT labels_.* FROM labels_ JOIN h USING (group_id) WHERE fold <> 0), {sql.group_folds("f", "train_", "group_id", "label", 3)}
    SELECT compound_id, fold FROM train_ JOIN f USING (group_id)""",
)
def stratified_cv_folds(spark, sf):
    """Three folds inside the training side of the hold-out."""
    held = splits.group_holdout(fx.labels(spark, sf), "group_id", "label", 0.2)
    train = held.where("NOT is_test").drop("is_test")
    return splits.stratified_group_folds(train, "group_id", "label", 3).select("compound_id", "fold")


@query(
    "group_folds_balanced",
    f"""WITH RECURSIVE {sql.LABELS}, {sql.group_folds("f", "labels_", "group_id", "0", 5)}
    SELECT compound_id, group_id, fold FROM labels_ JOIN f USING (group_id)""",
)
def group_folds_balanced(spark, sf):
    return splits.balanced_group_folds(fx.labels(spark, sf), "group_id", 5).drop("label")


# One group with half of all rows, seven with most of the others, and many small ones.
_UNEVEN = """uneven_ AS (
  SELECT o_orderkey AS compound_id, CAST(o_orderpriority = '1-URGENT' AS INT) AS label,
    CASE WHEN o_orderkey % 2 = 0 THEN -1 WHEN o_custkey % 97 < 40 THEN o_custkey % 7 ELSE o_custkey END AS grp FROM orders)"""


@query(
    "uneven_group_folds",
    f"""WITH RECURSIVE {_UNEVEN}, {sql.group_folds("f", "uneven_", "grp", "label", 4)}
    SELECT compound_id, grp, label, fold FROM uneven_ JOIN f USING (grp)""",
)
def uneven_group_folds(spark, sf):
    """Folds over groups of which one holds half of the rows and seven hold most of the rest."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    grp = F.when(key % 2 == 0, -1).when(customer % 97 < 40, customer % 7).otherwise(customer)
    rows = fx.table(spark, sf, "orders").select(
        key.alias("compound_id"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"), grp.cast("long").alias("grp")
    )
    return splits.stratified_group_folds(rows, "grp", "label", 4)


@query(
    "stratified_halves",
    f"""WITH {sql.LABELS}
    SELECT compound_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', compound_id)), compound_id) - 1) % 2 AS INT) AS half FROM labels_""",
)
def stratified_halves(spark, sf):
    return splits.stratified_halves(fx.labels(spark, sf).drop("group_id"), "compound_id", "label")


@query(
    "adversarial_split",
    f"WITH {sql.ADVERSARIAL} SELECT compound_id, adversarial_score, adversarial_score >= (SELECT quantile_cont(adversarial_score, 0.85) FROM adv) AS is_test FROM adv",
)
def adversarial_split(spark, sf):
    return splits.adversarial_split(
        fx.adv_scores(spark, sf).select("compound_id", "adversarial_score"), "adversarial_score", 0.15
    )


@query("percentile_cut", f"WITH {sql.ADVERSARIAL} SELECT ROUND(quantile_cont(adversarial_score, 0.85), 9) AS cut FROM adv")
def percentile_cut(spark, sf):
    return rounded(splits.percentile_cut(fx.adv_scores(spark, sf), "adversarial_score", 0.85), "cut", digits=9)


@query(
    "split_report",
    f"""WITH {sql.ADVERSARIAL}, t AS (SELECT *, adversarial_score >= (SELECT quantile_cont(adversarial_score, 0.85) FROM adv) AS is_test FROM adv)
    SELECT is_test, COUNT(*) AS n, MIN(adversarial_score) AS min_score, MAX(adversarial_score) AS max_score FROM t GROUP BY 1""",
)
def split_report(spark, sf):
    return splits.split_report(
        splits.adversarial_split(fx.adv_scores(spark, sf), "adversarial_score", 0.15), "adversarial_score"
    )


# Orders of customers in the building segment stand for the rows of a split.
_MEMBERS = "SELECT o_orderkey AS compound_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'"


def _members(spark, sf):
    chosen = fx.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return fx.table(spark, sf, "orders").join(chosen, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("compound_id"))


@query("semi_join_rows", WIDE + f"SELECT * FROM scores WHERE compound_id IN ({_MEMBERS})")
def semi_join_rows(spark, sf):
    return joins.only_rows(fx.expert_scores(spark, sf), _members(spark, sf), "compound_id")


@query("anti_join_rows", WIDE + f"SELECT * FROM scores WHERE compound_id NOT IN ({_MEMBERS})")
def anti_join_rows(spark, sf):
    return joins.without_rows(fx.expert_scores(spark, sf), _members(spark, sf), "compound_id")


@query("label_join", LONG + "SELECT compound_id, model, prob, group_id, labels_.label FROM long JOIN labels_ USING (compound_id)")
def label_join(spark, sf):
    long = fx.expert_scores_long(spark, sf).drop("label")
    return joins.with_labels(long, fx.labels(spark, sf), "compound_id")


@query(
    "expert_matrix",
    LONG + "SELECT compound_id, MAX(prob) FILTER (model = 'a') AS a, MAX(prob) FILTER (model = 'b') AS b, MAX(prob) FILTER (model = 'c') AS c FROM long WHERE model <> 'c' OR prob >= 0.1 GROUP BY 1",
)
def expert_matrix(spark, sf):
    partial = fx.expert_scores_long(spark, sf).where("model <> 'c' OR prob >= 0.1")
    return joins.expert_matrix(partial, fx.EXPERTS, "compound_id")


@query("attach_ids", WIDE + """SELECT concat('C', s.compound_id) AS "RandomID", a AS "DELLabel" FROM scores s JOIN orders ON o_orderkey = compound_id""")
def attach_ids(spark, sf):
    ids = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("compound_id"), F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("RandomID")
    )
    scored = joins.with_labels(fx.expert_scores(spark, sf), ids, "compound_id")
    return scored.select("RandomID", F.col("a").alias("DELLabel"))


@query(
    "attach_adversarial",
    f"WITH {sql.COMPOUNDS}, x AS (SELECT *, CAST((group_id * 31 + compound_id * 17) % 10007 AS DOUBLE) / 10007 AS adversarial_score FROM compounds) SELECT compound_id, label, fp_supp, adversarial_score FROM x",
)
def attach_adversarial(spark, sf):
    scores = fx.adv_scores(spark, sf).select("compound_id", "adversarial_score")
    table = fx.compounds(spark, sf).select("compound_id", "label", "fp_supp")
    return joins.with_labels(table, scores, "compound_id")


@query("average_ensemble", WIDE + "SELECT compound_id, ROUND((a + b + c) / 3, 6) AS prob FROM scores")
def average_ensemble(spark, sf):
    scores = fx.expert_scores(spark, sf)
    return scores.select("compound_id", F.round(ensemble.row_mean(fx.EXPERTS), 6).alias("prob"))


_UNCERTAIN = f"""WITH {sql.EXPERTS},
m AS (SELECT *, (a + b + c) / 3 AS mean FROM scores),
u AS (SELECT *, sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)) / 3) AS uncertainty FROM m)"""


@query(
    "uncertainty_stats",
    _UNCERTAIN + 'SELECT ROUND(AVG(uncertainty), 6) AS mean, ROUND(STDDEV_POP(uncertainty), 6) AS std, ROUND(MIN(uncertainty), 6) AS "min", ROUND(MAX(uncertainty), 6) AS "max" FROM u',
)
def uncertainty_stats(spark, sf):
    scores = fx.expert_scores(spark, sf).withColumn("uncertainty", ensemble.row_std(fx.EXPERTS))
    return rounded(metrics.uncertainty_stats(scores), "mean", "std", "min", "max")


@query(
    "confidence_rank",
    _UNCERTAIN + """, r AS (SELECT compound_id, ROUND(mean, 6) AS meta_probability, ROUND(uncertainty, 6) AS uncertainty FROM u),
    c AS (SELECT *, meta_probability * (1 - uncertainty) AS s FROM r)
    SELECT compound_id, meta_probability, uncertainty, ROUND(s, 9) AS confidence_score, row_number() OVER (ORDER BY s DESC, compound_id) AS rank FROM c""",
)
def confidence_rank(spark, sf):
    scores = fx.expert_scores(spark, sf).select(
        "compound_id",
        F.round(ensemble.row_mean(fx.EXPERTS), 6).alias("p"),
        F.round(ensemble.row_std(fx.EXPERTS), 6).alias("u"),
    )
    return rounded(ensemble.rank_by_confidence(scores, "compound_id", "p", "u"), "confidence_score", digits=9)


@query(
    "sweep_report",
    _REPORT + f""", {_AUC},
    names AS (SELECT * FROM (VALUES ('a', 'TOPTOR, ECFP6'), ('b', 'ATOMPAIR'), ('c', 'ECFP6, FCFP6')) n(model, features_tested))
    SELECT features_tested, ROUND(p, 6) AS "precision", ROUND(r, 6) AS recall, ROUND(f1, 6) AS f1_score, ROUND(roc_auc, 6) AS roc_auc_score
    FROM rep JOIN auc USING (model) JOIN names USING (model) WHERE class = '1'""",
)
def sweep_report(spark, sf):
    """Metrics of three runs, one folder each, gathered into the report of a sweep."""
    base = scratch_path(spark, "sweep")
    runs = {"a": "TOPTOR_ECFP6", "b": "ATOMPAIR", "c": "ECFP6_FCFP6"}
    scores = fx.expert_scores(spark, sf)
    for expert, names in runs.items():
        bundle = metrics.evaluation_bundle(scores, "label", expert)
        src.write_json(bundle, f"{base}/featsel__{names}_20250101-000000/test_metrics.json")
    report = experiment.sweep_report(src.read_run_metrics(spark, base, "featsel_*"))
    return rounded(report, "precision", "recall", "f1_score", "roc_auc_score")
