"""Column profiling: ranges, nulls, describe, value counts, cluster sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.fingerprint import fp_length, parse_lenient
from assaykit.functions.scalars import is_missing
from assaykit.operators.ordered import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _NUMERIC)]


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _stack(cols: list[str], value: dict[str, Column]) -> Column:
    """One (column, value...) row per listed column, exploded from an array of structs."""
    return F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), *[v.alias(n) for n, v in value[c].items()]) for c in cols])
    ).alias("s")


def _unpivot_aggregates(row: DataFrame, cols: list[str], stats: list[str]) -> DataFrame:
    """Turn one row of ``<column>|<stat>`` aggregates into one row per column."""
    value = {c: {s: F.col(f"`{c}|{s}`") for s in stats} for c in cols}
    return row.select(_stack(cols, value)).select("s.*")


def fp_ranges(df: DataFrame, fp_cols: list[str]) -> DataFrame:
    """Smallest and largest element per fingerprint column; malformed strings are skipped.

    One scan, two numbers per column; no per-element rows are made.
    """
    aggs = []
    for c in fp_cols:
        values = parse_lenient(c)
        aggs += [
            F.min(F.array_min(values)).alias(f"{c}|min_value"),
            F.max(F.array_max(values)).alias(f"{c}|max_value"),
        ]
    return _unpivot_aggregates(df.agg(*aggs), fp_cols, ["min_value", "max_value"])


def column_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null and non-null counts per column, NaN counted as null, in one scan."""
    cols = cols or df.columns
    kinds = _types(df)
    aggs = [F.sum(is_missing(c, kinds[c]).cast("long")).alias(f"{c}|nulls") for c in cols]
    aggs += [F.count(F.lit(1)).alias(f"{c}|rows") for c in cols]
    counts = _unpivot_aggregates(df.agg(*aggs), cols, ["nulls", "rows"])
    nulls, rows = F.coalesce("nulls", F.lit(0)), F.col("rows")
    return counts.select(
        "column",
        (rows - nulls).alias("non_nulls"),
        nulls.alias("nulls"),
        F.when(rows > 0, nulls * 100.0 / rows).otherwise(0.0).alias("null_pct"),
    )


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    kinds = _types(df)
    for c in cols:
        df = df.where(~is_missing(c, kinds[c]))
    return df


def describe_long(long: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max of a long (group, value) table."""
    clean = long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    v = F.col(value).cast("double")
    basic = clean.groupBy(group).agg(
        F.count("*").alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    return basic.join(exact_quantiles(clean, value, QUARTILES, [group]), group).select(
        group, "count", "mean", "std", "min", *QUARTILES, "max"
    )


def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Describe numeric columns; all columns share one sort of their distinct values."""
    cols = cols or numeric_columns(df)
    value = {c: {"value": F.col(c).cast("double")} for c in cols}
    return describe_long(df.select(_stack(cols, value)).select("s.*"), "column", "value")


def fp_lengths(df: DataFrame, fp_cols: list[str]) -> DataFrame:
    """Describe the number of elements per fingerprint column."""
    value = {c: {"value": fp_length(c)} for c in fp_cols}
    return describe_long(df.select(_stack(fp_cols, value)).select("s.*"), "column", "value")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value.

    Values are counted first; the rank filter is then pushed below the shuffle by Spark, so a
    task sees ``k`` rows of each upstream partition and never all distinct values of a column.
    """
    value = {c: {"value": F.col(c).cast("string")} for c in cols}
    counts = (
        df.select(_stack(cols, value))
        .select("s.*")
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def label_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    # one row per label value: the total is a window over a handful of rows
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select(label, "n", share.alias("share"))


def _as_text(ranked: DataFrame) -> DataFrame:
    entry = F.struct("rank", F.concat_ws("=", "value", F.col("n").cast("string")).alias("t"))
    listed = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"])
    return ranked.groupBy("column").agg(F.array_join(listed, "; ").alias("top_values"))


def column_report(df: DataFrame, fp_cols: list[str], label: str | None = None) -> DataFrame:
    """One row per column: type, nulls, and the statistics that fit its kind.

    Fingerprints are described by length, numbers by value, the label by all its counts and
    any other column by its five most frequent values.
    """
    kinds = _types(df)
    numeric = [c for c in numeric_columns(df) if c != label and c not in fp_cols]
    other = [c for c in df.columns if c not in numeric and c not in fp_cols and c != label]
    value = {c: {"value": fp_length(c).cast("double")} for c in fp_cols}
    value |= {c: {"value": F.col(c).cast("double")} for c in numeric}
    kind_of = {**dict.fromkeys(fp_cols, "fingerprint"), **dict.fromkeys(numeric, "numeric")}
    kind_of |= dict.fromkeys(other, "other") | ({label: "label"} if label else {})

    report = column_nulls(df)
    kind_map = F.create_map(*[F.lit(x) for c in df.columns for x in (c, kind_of[c])])
    type_map = F.create_map(*[F.lit(x) for c in df.columns for x in (c, kinds[c])])
    report = report.withColumn("kind", kind_map[F.col("column")]).withColumn("data_type", type_map[F.col("column")])
    if value:
        described = df.select(_stack(list(value), value)).select("s.*")
        report = report.join(describe_long(described, "column", "value"), "column", "left")
    text = []
    if other:
        text.append(_as_text(top_values(df, other, 5)))
    if label:
        # a class label has a handful of values, and the report lists them all
        classes = value_counts(df, label).select(F.col(label).cast("string").alias("value"), "n")
        order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        ranked = classes.withColumn("column", F.lit(label)).withColumn("rank", F.row_number().over(order))
        text.append(_as_text(ranked))
    if text:
        tops = text[0] if len(text) == 1 else text[0].unionByName(text[1])
        report = report.join(tops, "column", "left")
    return report


def hit_rate(df: DataFrame, label: str | None = None, probability: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Total, hits and hit rate in percent, from a 0/1 column or a probability and a cut."""
    if (label is None) == (probability is None):
        raise ValueError("give either label or probability")
    hit = F.col(label) if label else (F.col(probability) >= threshold)
    totals = df.agg(F.count("*").alias("total"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("hits"))
    rate = F.when(F.col("total") > 0, F.col("hits") * 100.0 / F.col("total")).otherwise(0.0)
    return totals.select("total", "hits", rate.alias("hit_rate"))


def by_building_block(df: DataFrame, keys: list[str]) -> DataFrame:
    """Compounds per building block or library."""
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(F.count("*").alias("n_compounds"))


def cluster_size_table(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n"))


def cluster_report(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Molecules, clusters, single-member clusters and the describe of cluster sizes, one row."""
    sizes = cluster_size_table(df, cluster)
    basic = sizes.agg(
        F.sum("n").alias("molecules"),
        F.count("*").alias("clusters"),
        F.sum((F.col("n") == 1).cast("long")).alias("singletons"),
        F.avg("n").alias("mean"),
        F.stddev_samp("n").alias("std"),
        F.min("n").alias("min"),
        F.max("n").alias("max"),
    )
    return basic.join(exact_quantiles(sizes, "n", QUARTILES), F.lit(True))


def largest_clusters(df: DataFrame, k: int = 10, cluster: str = "cluster_id") -> DataFrame:
    """Top-k report of cluster sizes."""
    return cluster_size_table(df, cluster).orderBy(F.desc("n"), cluster).limit(k)


def cluster_histogram(df: DataFrame, bins: int = 50, cluster: str = "cluster_id") -> DataFrame:
    """Cluster sizes in ``bins`` log-spaced bins between the smallest and the largest size."""
    per_size = cluster_size_table(df, cluster).groupBy("n").agg(F.count("*").alias("clusters"))
    lo, hi = per_size.agg(F.min("n"), F.max("n")).first()
    if lo is None:
        return per_size.select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_low"), "clusters").limit(0)
    low, high = math.log10(lo), math.log10(hi)
    if high == low:  # a single size: one bin of unit width around it
        low, high = low - 0.5, high + 0.5
    # the largest size belongs to the last bin
    bucket = F.least(F.width_bucket(F.log10("n"), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    step = (high - low) / bins
    return (
        per_size.groupBy(bucket.cast("int").alias("bin"))
        .agg(F.sum("clusters").alias("clusters"))
        .withColumn("bin_low", F.pow(F.lit(10.0), F.lit(low) + (F.col("bin") - 1) * step))
    )
