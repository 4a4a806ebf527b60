"""Combining expert models: averages, disagreement, ranking, stacking and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalars import confidence
from assaykit.operators.joins import complete_models, only_rows
from assaykit.operators.metrics import model_comparison
from assaykit.operators.models import FEATURES, classifier_stages
from assaykit.operators.ordered import global_rank
from assaykit.operators.splits import stratified_halves
from assaykit.session import materialize

META_KINDS = {"Logistic Regression": "logistic_regression", "Random Forest": "random_forest"}
# Labels of the combined models in a comparison table.
AVERAGE_NAME = "Ensemble (Average)"
STACKING_NAME = "Stacking ({})"


def row_mean(cols: list[str]) -> Column:
    """Mean over columns of one row; null columns count as absent."""
    total = reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0.0)) for c in cols])
    present = reduce(lambda x, y: x + y, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.try_divide(total, present)


def row_std(cols: list[str]) -> Column:
    """Population standard deviation over columns of one row."""
    mean = row_mean(cols)
    squares = [F.coalesce((F.col(c) - mean) * (F.col(c) - mean), F.lit(0.0)) for c in cols]
    present = reduce(lambda x, y: x + y, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.sqrt(F.try_divide(reduce(lambda x, y: x + y, squares), present))


def rank_by_confidence(df: DataFrame, id_col: str, probability: str, uncertainty: str) -> DataFrame:
    """Analysis table: probability, uncertainty, confidence and rank, 1 for the most confident."""
    scored = df.select(
        id_col,
        F.col(probability).alias("meta_probability"),
        F.col(uncertainty).alias("uncertainty"),
        confidence(F.col(probability), F.col(uncertainty)).alias("confidence_score"),
    )
    return global_rank(scored, [F.desc("confidence_score"), F.col(id_col)], "rank")


def submission(ranked: DataFrame, id_col: str | None) -> DataFrame:
    """(id, probability) in the shape of a prediction file."""
    prob = F.col("meta_probability").alias("DELLabel")
    return ranked.select(id_col, prob) if id_col else ranked.select(prob)


def score_with(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Add one probability column; what the model's stages add on the way is left out."""
    return model.transform(df).select(*df.columns, F.col("prob").alias(name))


def expert_scores(experts: dict[str, PipelineModel], df: DataFrame, ids: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """All experts on the same scan, one probability column each; ``ids`` limits the rows."""
    chosen = only_rows(df, ids, key)
    return reduce(lambda d, item: score_with(item[1], d, item[0]), experts.items(), chosen)


def _long(wide: DataFrame, names: list[str], label: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"`{n}`").alias("prob")) for n in names]))
    return wide.select(label, pairs.alias("s")).select(label, "s.*")


def fit_meta(wide: DataFrame, experts: list[str], label: str, kind: str = "logistic_regression", params: dict | None = None) -> PipelineModel:
    """Stacking model on expert probabilities, classes balanced."""
    stages = [VectorAssembler(inputCols=experts, outputCol=FEATURES), *classifier_stages(kind, label, params)]
    return Pipeline(stages=stages).fit(wide)


def stacked_scores(
    experts: dict[str, PipelineModel], holdout: DataFrame, new: DataFrame, id_col: str, label: str
) -> DataFrame:
    """Train the stacking model on held-out rows and score new rows.

    Returns the id, one column per expert, ``meta_probability`` and ``uncertainty``.
    """
    names = sorted(experts)
    ordered = {n: experts[n] for n in names}
    # the meta model reads these rows many times while it is fitted; the features are not kept
    held = materialize(expert_scores(ordered, holdout).select(*names, label), "meta")
    meta = fit_meta(held, names, label)
    scored = score_with(meta, expert_scores(ordered, new).select(id_col, *names), "meta_probability")
    return scored.withColumn("uncertainty", row_std(names))


def evaluate_ensemble(
    experts: dict[str, PipelineModel],
    holdout: DataFrame,
    id_col: str,
    label: str,
    threshold: float = 0.5,
    seed: int = 42,
    forest_params: dict | None = None,
) -> DataFrame:
    """Compare every expert, their average and two stacking models on half of the held-out rows.

    The other half trains the stacking models. One scan scores all experts, and one job
    evaluates all models.
    """
    halves = stratified_halves(holdout, id_col, label, seed)
    wide = expert_scores(experts, halves).select(id_col, label, "half", *experts)
    wide = materialize(wide, "expert_scores")
    counts = {
        h: _long(wide.where(F.col("half") == h), list(experts), label).where("prob IS NOT NULL") for h in (0, 1)
    }
    sizes = {r["half"]: r["n"] for r in wide.groupBy("half").agg(F.count("*").alias("n")).collect()}
    complete = [complete_models(counts[h], sizes.get(h, 0)) for h in (0, 1)]
    names = sorted(r["model"] for r in complete[0].intersect(complete[1]).collect())
    if not names:
        raise ValueError("no expert scored every row of both halves")
    train, test = wide.where("half = 0"), wide.where("half = 1")
    test = test.withColumn(AVERAGE_NAME, row_mean(names))
    for title, kind in META_KINDS.items():
        params = forest_params if kind == "random_forest" else None
        meta = fit_meta(train, names, label, kind, params)
        test = score_with(meta, test, STACKING_NAME.format(title))
    all_names = [AVERAGE_NAME, *[STACKING_NAME.format(t) for t in META_KINDS], *names]
    return model_comparison(_long(test, all_names, label), label, "prob", threshold=threshold)
