"""Numeric scaling and truncated SVD as ML stages that save and load with their pipeline."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.fingerprint import sized

# Up to this width the Gram matrix (width^2 doubles) is summed in one pass over the rows;
# wider input goes to the iterative solver, which never forms it.
MAX_GRAM_WIDTH = 4096
SLICE_NUMBERS = 1 << 22  # products that a projection holds at once


class NumericScaler(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Centre and divide by the population standard deviation; a constant column becomes 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NumericScalerModel:
        cols = self.getInputCols()
        row = df.agg(
            *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
        ).first()
        means, stds = ([row[f"{p}{i}"] for i in range(len(cols))] for p in "ms")
        empty = [c for c, m in zip(cols, means) if m is None]
        if empty:
            raise ValueError(f"no values to scale in {empty}")
        return NumericScalerModel(
            inputCols=cols, outputCol=self.getOutputCol(), means=means, stds=stds
        )


class NumericScalerModel(Model, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean per column", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population standard deviation per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def columns(self) -> list:
        """Scaled value of each input column, in order."""
        means, stds = self.getOrDefault(self.means), self.getOrDefault(self.stds)
        return [
            (F.col(c).cast("double") - F.lit(m)) / F.lit(s or 1.0)
            for c, m, s in zip(self.getInputCols(), means, stds)
        ]

    def _transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.getInputCols() if c not in df.columns]
        if missing:
            raise ValueError(f"numeric column(s) missing: {missing}")
        scaled = df.withColumn(self.getOutputCol(), array_to_vector(F.array(*self.columns())))
        return sized(scaled, self.getOutputCol(), len(self.getInputCols()))


def scale_columns(df: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """Fit on ``df`` and add one scaled column per input column."""
    model = NumericScaler(inputCols=cols, outputCol="unused").fit(df)
    return df.withColumns({f"{c}{suffix}": v for c, v in zip(cols, model.columns())})


def _row_matrix(df: DataFrame, col: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(col), col))


def _filled(basis: np.ndarray, moments: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``k`` orthonormal columns: the solver gives none for a singular value of zero."""
    missing = k - basis.shape[1]
    if missing <= 0:
        return basis, moments
    seen = basis.shape[1]
    any_vectors = np.random.default_rng(0).standard_normal((basis.shape[0], missing))
    rest = np.linalg.qr(np.hstack([basis, any_vectors]))[0][:, seen:]
    return np.hstack([basis, rest]), np.concatenate([moments, np.zeros(missing)])


def project_batch(index: pa.Array, value: pa.Array, basis: np.ndarray) -> pa.Array:
    """Rows of a sparse matrix, lists of indices and values, times ``basis``; a list of indices is null in a dense row.

    Rows are taken in slices of a bounded number of elements, and the products of a slice added up per row.
    """
    k = basis.shape[1]
    lengths = pc.list_value_length(value).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    values = value.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(len(values)) - np.repeat(ends - lengths, lengths)
    at[np.repeat(index.is_valid().to_numpy(zero_copy_only=False), lengths)] = index.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(value), k))
    most = max(1, SLICE_NUMBERS // k)
    row = 0
    while row < len(value):
        begin = ends[row] - lengths[row]
        to = max(row + 1, int(np.searchsorted(ends, begin + most, "right")))
        some = np.flatnonzero(lengths[row:to]) + row
        if len(some):
            products = values[begin : ends[to - 1], None] * basis[at[begin : ends[to - 1]]]
            out[some] = np.add.reduceat(products, ends[some] - lengths[some] - begin, axis=0)
        row = to
    return pa.ListArray.from_arrays(pa.array(np.arange(len(value) + 1) * k, pa.int32()), pa.array(out.ravel()))


class TruncatedSVD(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Uncentred truncated SVD. Unlike PCA it keeps sparse input sparse."""

    k = Param(Params._dummy(), "k", "number of components", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, k=200):
        super().__init__()
        self._setDefault(k=200)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> TruncatedSVDModel:
        col, k = self.getInputCol(), self.getOrDefault(self.k)
        summary = df.agg(
            Summarizer.metrics("mean", "variance", "count").summary(F.col(col)).alias("s")
        ).first()["s"]
        mean, n = summary["mean"].toArray(), summary["count"]
        if not n:
            raise ValueError("no rows to decompose")
        width = len(mean)
        if not 0 < k <= width:
            raise ValueError(f"k must be between 1 and the input width {width}")
        total = float(summary["variance"].toArray().sum()) * (n - 1) / n
        matrix = _row_matrix(df, col)
        if width <= MAX_GRAM_WIDTH:
            gram = matrix.computeGramianMatrix().toArray()
            values, vectors = np.linalg.eigh(gram)
            top = np.argsort(values)[::-1][:k]
            basis = vectors[:, top]
            second_moment = np.einsum("ij,ij->j", basis, gram @ basis) / n
        else:
            svd = matrix.computeSVD(k)
            basis, second_moment = _filled(svd.V.toArray(), svd.s.toArray() ** 2 / n, k)
        # variance of a projection is its second moment less the squared projected mean
        variance = np.maximum(second_moment - (mean @ basis) ** 2, 0.0)
        ratio = variance / total if total > 0 else np.zeros(basis.shape[1])
        # the sign of a singular vector is arbitrary: make its largest entry positive
        lead = basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]
        model = TruncatedSVDModel(inputCol=col, outputCol=self.getOutputCol())
        model.components = basis * np.where(lead < 0, -1.0, 1.0)
        model.explained_variance_ratio = ratio
        return model


class TruncatedSVDModel(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Projects a vector column on the fitted components."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)
        self.components: np.ndarray | None = None
        self.explained_variance_ratio: np.ndarray | None = None

    def copy(self, extra=None):
        that = super().copy(extra)
        that.components = self.components
        that.explained_variance_ratio = self.explained_variance_ratio
        return that

    def _transform(self, df: DataFrame) -> DataFrame:
        # width x k doubles, both fixed by the model and independent of the row count
        basis = df.sparkSession.sparkContext.broadcast(self.components)

        def project(index: pa.Array, value: pa.Array) -> pa.Array:
            return project_batch(index, value, basis.value)

        # indices and values as stored, so a sparse vector is never made dense
        parts = F.unwrap_udt(F.col(self.getInputCol()))
        projected = F.arrow_udf(project, "array<double>")(parts["indices"], parts["values"])
        reduced = df.withColumn(self.getOutputCol(), array_to_vector(projected))
        return sized(reduced, self.getOutputCol(), self.components.shape[1])

    def write(self) -> MLWriter:
        return _SVDWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SVDReader(cls)


class _SVDWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        rows = [
            (j, self.instance.components[:, j].tolist(), float(r))
            for j, r in enumerate(self.instance.explained_variance_ratio)
        ]
        self.sparkSession.createDataFrame(
            rows, "component int, vector array<double>, ratio double"
        ).write.parquet(f"{path}/data")


class _SVDReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        rows = self.sparkSession.read.parquet(f"{path}/data").orderBy("component").collect()
        instance.components = np.array([r["vector"] for r in rows]).T
        instance.explained_variance_ratio = np.array([r["ratio"] for r in rows])
        return instance


def variance_table(model: TruncatedSVDModel, spark) -> DataFrame:
    """Explained-variance ratio per component and its running sum (one row per component)."""
    rows = [(i + 1, float(r)) for i, r in enumerate(model.explained_variance_ratio)]
    table = spark.createDataFrame(rows, "component int, explained_variance_ratio double")
    running = Window.partitionBy().orderBy("component")
    return table.withColumn("cumulative", F.sum("explained_variance_ratio").over(running))


def svd_sweep(df: DataFrame, col: str, max_components: int) -> DataFrame:
    """Variance table up to ``max_components``, lowered to width - 1 when that is smaller."""
    first: Vector = df.select(col).first()[0]
    k = min(max_components, len(first) - 1)
    model = TruncatedSVD(inputCol=col, outputCol="__svd", k=k).fit(df)
    return variance_table(model, df.sparkSession)
