"""Keyed joins that replace alignment by file position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.session import broadcast_if_small

# A key is hot when it holds more than this share of the rows, or more than this many of them.
HOT_SHARE = 1 / 1000
ROWS_PER_COPY = 1_000_000


def only_rows(df: DataFrame, ids: DataFrame | None, key: str = "row_id") -> DataFrame:
    """Keep rows whose key is in ``ids``; None keeps all rows, an empty set keeps none."""
    return df if ids is None else df.join(ids.select(key), key, "left_semi")


def without_rows(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def with_labels(scores: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    return scores.join(labels, key)


def expert_matrix(long: DataFrame, models: list[str], key: str = "row_id", model: str = "model", score: str = "prob") -> DataFrame:
    """Long (key, model, score) to one column per model; a row missing from a model is null.

    A (key, model) that is repeated gives its largest score.
    """
    return long.groupBy(key).pivot(model, models).agg(F.max(score))


def complete_models(long: DataFrame, n_rows: int, model: str = "model") -> DataFrame:
    """Models that scored exactly ``n_rows`` rows."""
    counts = long.groupBy(model).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") == n_rows).select(model)


def common_models(left: DataFrame, right: DataFrame, model: str = "model") -> DataFrame:
    """Models present on both sides, by name."""
    return left.select(model).intersect(right.select(model)).orderBy(model)


def attach_by_key(
    rows: DataFrame, lookup: DataFrame, key: str, weight: str, values: list[str], total: int | None = None
) -> DataFrame:
    """Add ``values`` from ``lookup`` (one row per key) to every row, hot keys spread over tasks.

    ``weight`` is the number of rows per key, which the callers know from the aggregate that
    built the lookup. Hot keys are broadcast by name only, their number checked, so that their rows
    take one of several copies of the lookup row; a key has as many copies as it holds hot shares.
    Null keys match null keys. ``total`` saves counting the rows when it is known.
    """
    total = total if total is not None else lookup.agg(F.sum(weight)).first()[0]
    target = max(1.0, min((total or 0) * HOT_SHARE, ROWS_PER_COPY))
    n_copies = F.ceil(F.col(weight) / F.lit(target)).cast("int")
    hot = lookup.where(F.col(weight) > target).select(F.col(key).alias("__hot_key"), n_copies.alias("__copies"))
    # below this total at most 1 / HOT_SHARE keys are hot
    hot = F.broadcast(hot) if target < ROWS_PER_COPY else broadcast_if_small(hot)
    copies = lookup.select(
        F.col(key).alias("__key"),
        *values,
        F.explode(
            F.when(F.col(weight) > target, F.sequence(F.lit(0), n_copies - 1)).otherwise(F.array(F.lit(0)))
        ).alias("__copy"),
    )
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key] or [key]), F.col("__copies")).cast("int")
    salted = rows.join(hot, F.col(key).eqNullSafe(F.col("__hot_key")), "left").withColumn(
        "__salt", F.when(F.col("__copies").isNotNull(), salt).otherwise(0)
    )
    matched = salted.join(
        copies, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__copy"))
    )
    return matched.drop("__hot_key", "__copies", "__key", "__salt", "__copy")
