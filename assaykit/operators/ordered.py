"""Global order without a single-task window.

A global sort is written once to the shared folder together with the sort partition of each
row. Per-partition totals then give every partition its offset, so ranks and running sums need
only windows inside a partition. Sort keys that carry most of the rows must be aggregated
first (all callers here do), which keeps the partitions even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.session import broadcast_if_small, materialize

_PART = "__part"
_POS = "__pos"
# monotonically_increasing_id keeps the row number of a partition in its low 33 bits
_LOW_BITS = (1 << 33) - 1


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sorted_table(df: DataFrame, order_by: list[Column]) -> DataFrame:
    mid = F.monotonically_increasing_id()
    return materialize(
        df.orderBy(*order_by)
        .withColumn(_PART, F.shiftright(mid, 33))
        .withColumn(_POS, mid.bitwiseAND(F.lit(_LOW_BITS))),
        "sorted",
    )


def global_rank(df: DataFrame, order_by: list[Column | str], name: str = "rank", start: int = 1) -> DataFrame:
    """Row number over a total order. ``order_by`` must be unique per row for repeatable ranks."""
    placed = _sorted_table(df, [_column(c) for c in order_by])
    sizes = placed.groupBy(_PART).agg(F.count("*").alias("__n"))
    # one row per sort partition, so this window is over a few thousand rows at most
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    ranked = placed.join(broadcast_if_small(offsets), _PART)
    return ranked.withColumn(name, F.col("__off") + F.col(_POS) + start).drop(_PART, _POS, "__off")


def rank_within(df: DataFrame, groups: list[str], order_by: list[Column | str], name: str = "rank") -> DataFrame:
    """Row number inside each group; a group may be spread over any number of tasks."""
    placed = _sorted_table(df, [*[F.col(g) for g in groups], *[_column(c) for c in order_by]])
    blocks = placed.groupBy(_PART, *groups).agg(F.count("*").alias("__n"), F.min(_POS).alias("__first"))
    before = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        _PART, *groups, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    ranked = placed.join(broadcast_if_small(offsets), [_PART, *groups])
    return ranked.withColumn(name, F.col("__off") + F.col(_POS) - F.col("__first") + 1).drop(
        _PART, _POS, "__first", "__off"
    )


def running_totals(
    df: DataFrame,
    groups: list[str],
    order_by: list[Column | str],
    sums: list[str],
    following: list[str] | None = None,
) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` and group totals ``total_<c>`` along a global order.

    ``df`` holds one row per group and order key. Each partition adds its own prefix sum to the
    total of the partitions before it. ``following`` adds ``next_<c>``, the value of the next
    row in the order; at the end of a partition that is the first value of the next one.
    """
    following = following or []
    order = [_column(c) for c in order_by]
    placed = _sorted_table(df, [*[F.col(g) for g in groups], *order])
    blocks = placed.groupBy(_PART, *groups).agg(
        *[F.sum(c).alias(f"__{c}") for c in sums],
        *[F.min_by(c, _POS).alias(f"__first_{c}") for c in following],
    )
    whole = Window.partitionBy(*groups)
    before = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        _PART,
        *groups,
        *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__off_{c}") for c in sums],
        *[F.sum(f"__{c}").over(whole).alias(f"total_{c}") for c in sums],
        *[F.lead(f"__first_{c}").over(whole.orderBy(_PART)).alias(f"__lead_{c}") for c in following],
    )
    inside = Window.partitionBy(_PART, *groups).orderBy(_POS)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(broadcast_if_small(offsets), [_PART, *groups])
    added = {f"cum_{c}": F.col(f"__off_{c}") + F.sum(c).over(so_far) for c in sums}
    added |= {f"next_{c}": F.coalesce(F.lead(c).over(inside), f"__lead_{c}") for c in following}
    return joined.withColumns(added).drop(
        _PART, _POS, *[f"__off_{c}" for c in sums], *[f"__lead_{c}" for c in following]
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], groups: list[str] | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group.

    Equal values are counted before the sort, and no task holds more than its share of the
    distinct values. Nulls and NaN are rejected by the filter, as their order is not a value.
    """
    groups = groups or []
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = clean.groupBy(*groups, value).agg(F.count("*").alias("__cnt"))
    placed = running_totals(counts, groups, [value], ["__cnt"])
    aggs, outs = [], []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("total___cnt") - 1)
        for side, index in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            holds = (index >= F.col("cum___cnt") - F.col("__cnt")) & (index < F.col("cum___cnt"))
            aggs.append(F.max(F.when(holds, F.col(value).cast("double"))).alias(f"__{side}_{name}"))
        aggs.append(F.max(spot - F.floor(spot)).alias(f"__frac_{name}"))
        lo, hi, frac = (F.col(f"__{s}_{name}") for s in ("lo", "hi", "frac"))
        outs.append((lo + (hi - lo) * frac).alias(name))
    return placed.groupBy(*groups).agg(*aggs).select(*groups, *outs)
