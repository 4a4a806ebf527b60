"""Quality classifier by co-training.

Two views of a document, its text and its metadata, each have a logistic model. In every round a
model labels the unlabelled documents that it is sure of, and the other model is fitted
again with those. At the end each view is calibrated on labelled rows held back from the fits, the
calibrated views are combined, and every document is scored in one pass without a shuffle.

Fits and calibration use every labelled document, so that the classes keep their shares at every
size, and the pool is every unlabelled document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from assaykit.llm.common import pick
from assaykit.llm.wordhash import Words, slices
from assaykit.session import broadcast_if_small, materialize

ROUNDS, SURE = 3, 0.97
KEEP_FROM = 0.5
_META = ["m_lang", "m_source", "m_size"]

# Kinds of bytes whose shares describe a text.
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\t\r", ".,;:'\"-()", "!?", "|", "#$%&*@^~=+<>\\/_`[]{}"]
_KIND = np.full(256, len(_KINDS), np.int64)
for _i, _chars in enumerate(_KINDS):
    _KIND[[ord(c) for c in _chars]] = _i
N_FEATURES = len(_KINDS) + 1 + 5


def text_features(w: Words) -> np.ndarray:
    """Shares of kinds of bytes, and sizes and repetition of words, for each text."""
    n, k = len(w.counts), len(_KINDS) + 1
    size = np.diff(w.offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * k, size) + _KIND[w.data], minlength=n * k).reshape(n, k)
    lines = kinds[:, _KINDS.index("\n\t\r")] + 1
    length = np.add.reduceat(np.append(w.ends - w.starts, 0), np.minimum(w.first[:-1], len(w.starts))) * (w.counts > 0)
    different = np.array([len(np.unique(w.hashes[a:b])) for a, b in zip(w.first[:-1], w.first[1:])])
    words = np.maximum(w.counts, 1)
    more = [np.log1p(w.counts), length / words, different / words, w.counts / lines, (w.counts == 0) * 1.0]
    return np.concatenate([kinds / np.maximum(size, 1)[:, None], np.stack(more, axis=1)], axis=1)


@F.arrow_udf(ArrayType(DoubleType()))
def _text_array(text: pa.Array) -> pa.Array:
    flat = [text_features(w).ravel() for _, _, w in slices(text)]
    values = np.concatenate([np.zeros(0), *flat])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * N_FEATURES, pa.int32()), pa.array(values))


def _featured(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` (with m_lang, m_source, m_size) with the vector of each view; only ``text`` goes through Python."""
    with_text = rows.withColumn("t_features", array_to_vector(_text_array(text)))
    return FeatureHasher(inputCols=_META, outputCol="m_features", numFeatures=256).transform(with_text)


def _views(at: dict[str, Column]) -> dict[str, Column]:
    size = F.log1p(F.greatest(F.coalesce(at["n_chars"].cast("double"), F.lit(0.0)), F.lit(0.0)))
    return {"m_lang": at["lang"].cast("string"), "m_source": at["source"].cast("string"), "m_size": size}


def _columns(docs: DataFrame) -> tuple[DataFrame, dict[str, Column], str]:
    """``docs`` by position, its columns by exact name, and the name of the text's; metadata that is not there is null."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    names = ("doc_id", "text", "lang", "source", "n_chars")
    at = {n: F.col(f"c{docs.columns.index(n)}") if n in docs.columns else F.lit(None) for n in names}
    return plain, at, f"c{docs.columns.index('text')}"


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(inside / (1 - inside))


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    return LogisticRegression(
        featuresCol=f"{view}_features", labelCol="y", rawPredictionCol=f"{view}_raw", probabilityCol=f"{view}_prob", predictionCol=f"{view}_pred",
        maxIter=25, regParam=0.005,
    ).fit(rows)


def _scored(model: LogisticRegressionModel, rows: DataFrame, view: str) -> DataFrame:
    out = model.transform(rows).withColumn(f"{view}_p", vector_to_array(f"{view}_prob")[1])
    return out.drop(f"{view}_raw", f"{view}_prob", f"{view}_pred")


class QualityModel:
    """The two views' models, and slope and intercept of each calibration and of their combination."""

    def __init__(self, text: LogisticRegressionModel, meta: LogisticRegressionModel, calibration: dict[str, tuple[float, float]], weights: tuple[float, float, float]):
        self.text, self.meta, self.calibration, self.weights = text, meta, calibration, weights

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with text_score, meta_score and score, in place of the vectors."""
        out = _scored(self.meta, _scored(self.text, rows, "t"), "m")
        logit = {v: self.calibration[v][0] * _logit(F.col(f"{v}_p")) + self.calibration[v][1] for v in "tm"}
        a, b, c = self.weights
        sigmoid = lambda x: 1 / (1 + F.exp(-x))
        out = out.withColumns({"text_score": sigmoid(logit["t"]), "meta_score": sigmoid(logit["m"]), "score": sigmoid(a * logit["t"] + b * logit["m"] + c)})
        return out.drop("t_features", "m_features", "t_p", "m_p")


def train(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """Fit on the documents that ``labels`` (doc_id, quality 0 or 1) covers; None without both classes.

    Documents with two different labels, null labels and null ids are not used.
    """
    known = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    known = materialize(known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")), "known")
    plain, at, text = _columns(docs)
    rows = plain.select(at["doc_id"].alias("doc_id"), text, *[c.alias(n) for n, c in _views(at).items()]).where("doc_id is not null")
    # features come before the join, so that no text is shuffled if it isn't a broadcast
    rows = _featured(rows, text).select("doc_id", "t_features", "m_features")
    rows = rows.join(broadcast_if_small(known), "doc_id", "left").where("y is null or y = z")
    rows = materialize(rows.select("doc_id", F.col("y").cast("double").alias("y"), "t_features", "m_features"), "featured")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0
    base = rows.where(F.col("y").isNotNull() & ~held)
    held_back, pool = rows.where(F.col("y").isNotNull() & held), rows.where("y is null").drop("y")
    n, n_good, m, m_good = (rows.where(F.col("y").isNotNull()).agg(
        F.count_if(~held), F.sum(F.when(~held, F.col("y"))), F.count_if(held), F.sum(F.when(held, F.col("y")))
    ).first())
    if not n or n_good in (None, 0, n):
        return None
    told: dict[str, DataFrame | None] = {"t": None, "m": None}
    models: dict[str, LogisticRegressionModel] = {}
    for turn in range(ROUNDS):
        for view in "tm":
            more = told[view]
            models[view] = _fit(base if more is None else base.select("y", f"{view}_features").unionByName(more), view)
        if turn + 1 < ROUNDS:
            for view, other in ("tm", "mt"):
                judged = _scored(models[other], pool, other)
                sure = judged.where((F.col(f"{other}_p") >= SURE) | (F.col(f"{other}_p") <= 1 - SURE))
                told[view] = materialize(sure.select((F.col(f"{other}_p") > 0.5).cast("double").alias("y"), f"{view}_features"), "pseudo")
    if not m or m_good in (None, 0, m):  # nothing to calibrate on
        return QualityModel(models["t"], models["m"], {"t": (1.0, 0.0), "m": (1.0, 0.0)}, (1.0, 0.0, 0.0))
    views = _scored(models["m"], _scored(models["t"], held_back, "t"), "m").select("y", *[_logit(F.col(f"{v}_p")).alias(f"{v}_l") for v in "tm"])
    views = materialize(views, "held")
    calibration = {}
    for v in "tm":
        fit = _fit(views.select("y", array_to_vector(F.array(f"{v}_l")).alias("x_features")), "x")
        calibration[v] = (float(fit.coefficients[0]), float(fit.intercept))
    both = F.array(*[calibration[v][0] * F.col(f"{v}_l") + calibration[v][1] for v in "tm"])
    fit = _fit(views.select("y", array_to_vector(both).alias("x_features")), "x")
    return QualityModel(models["t"], models["m"], calibration, (float(fit.coefficients[0]), float(fit.coefficients[1]), float(fit.intercept)))


def _judged(docs: DataFrame, model: QualityModel | None) -> tuple[DataFrame, dict[str, Column]]:
    plain, at, text = _columns(docs)
    if model is None:
        one = F.lit(1.0)
        return plain.withColumns({"text_score": one, "meta_score": one, "score": one}), at
    return model.score(_featured(plain.withColumns(_views(at)), text)), at


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, text_score, meta_score, score and kept (score at least 0.5).

    Scores are probabilities of good quality. Null texts count as empty, null metadata adds nothing
    to its view, and columns that are missing count as null. If the labels lack a class every score
    is 1 and every row is kept. Repeated rows repeat; an empty table gives an empty table.
    """
    judged, at = _judged(docs, train(docs, labels))
    return judged.select(at["doc_id"].alias("doc_id"), "text_score", "meta_score", "score", (F.col("score") >= KEEP_FROM).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    judged, _ = _judged(docs, train(docs, labels))
    return judged.where(F.col("score") >= KEEP_FROM).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
