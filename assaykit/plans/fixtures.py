"""Screening-shaped tables derived from the given TPC-H-like tables.

The engine works on compounds with text fingerprints; the test tables hold orders and lines. An
order stands for a compound, its customer for the compound's group, and counts of part and
supplier numbers modulo a width for two fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.session import materialize

PART_WIDTH, SUPP_WIDTH = 64, 32
EXPERTS = ["a", "b", "c"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _count_texts(rows: np.ndarray, at: np.ndarray, counts: np.ndarray, widths: np.ndarray) -> pa.Array:
    """One text of comma-separated counts a row: the sum of ``counts`` at each (row, position) within the row's width."""
    n, width = len(widths), int(widths.max(initial=1))
    held = (at >= 0) & (at < widths[rows])
    cells, which = np.unique(rows[held] * width + at[held], return_inverse=True)
    totals = np.zeros(len(cells), np.int64)
    np.add.at(totals, which, counts[held])
    digits = np.full((n, width, 2), 44, np.uint8)  # a digit and a comma for each position
    digits[:, :, 0] = 48
    digits[cells // width, cells % width, 0] = 48 + np.minimum(totals, 9)
    inside = np.arange(2 * width) < 2 * widths[:, None] - 1
    offsets = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
    text = digits.reshape(n, 2 * width)[inside]
    made = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(text))
    long = np.unique(cells[totals > 9] // width)
    if not len(long):
        return made
    # counts of more digits, in few rows: their texts are put together element by element
    replaced = made.to_pylist()
    for row in long:
        a, b = np.searchsorted(cells, [row * width, (row + 1) * width])
        elements = np.zeros(widths[row], np.int64)
        elements[cells[a:b] % width] = totals[a:b]
        replaced[row] = ",".join(map(str, elements))
    return pa.array(replaced, pa.string())


def _texts(entries: pa.Array, supp_width: pa.Array) -> pa.Array:
    """Both texts from counted pairs of a part and a supplier position, -1 for none."""
    part_at, supp_at, counts = (entries.flatten().field(c).to_numpy() for c in "psv")
    rows = np.repeat(np.arange(len(entries)), entries.value_lengths().to_numpy())
    part = _count_texts(rows, part_at, counts, np.full(len(entries), PART_WIDTH))
    supp = _count_texts(rows, supp_at, counts, supp_width.to_numpy())
    return pa.StructArray.from_arrays([part, supp], ["fp_part", "fp_supp"])


def compounds(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda c, width: F.coalesce((F.col(c) % width).cast("int"), F.lit(-1))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), at("l_partkey", PART_WIDTH).alias("p"), at("l_suppkey", SUPP_WIDTH).alias("s")
    )
    # counted per pair first, so an order contributes a bounded number of entries
    counts = lines.groupBy("k", "p", "s").agg(F.count("*").alias("v"))
    # building the text is work per row, not per byte: keep the full number of tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = counts.repartition(tasks, "k")
    # every 101st fingerprint is one element short, the wrong-length case
    supp_width = F.when(F.col("k") % 101 == 0, SUPP_WIDTH - 1).otherwise(SUPP_WIDTH)
    entries = spread.groupBy("k").agg(F.collect_list(F.struct("p", "s", "v")).alias("e"))
    built = F.arrow_udf(_texts, "struct<fp_part: string, fp_supp: string>")("e", supp_width)
    texts = entries.select(F.col("k").alias("compound_id"), built.alias("t")).select("compound_id", "t.*")
    # the Python step drops the partitioning, so the join deals the texts out again: to as many tasks
    texts = texts.repartition(tasks, "compound_id")
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(
        key.alias("compound_id"),
        F.col("o_custkey").alias("group_id"),
        _label().alias("label"),
        F.col("o_totalprice").alias("mw"),
        ((key % 1000).cast("double") / 100 - 5).alias("alogp"),
    )
    # a merge join keeps the tasks of the text side; the size estimate would broadcast it
    return orders.join(texts.hint("merge"), "compound_id", "left").select(
        "compound_id", "group_id", "label", "fp_part", "fp_supp", "mw", "alogp"
    )


def compounds_file(spark: SparkSession, sf: str) -> DataFrame:
    """The compound table as a Parquet file, for work that reads it more than once."""
    return materialize(compounds(spark, sf), "compounds")


def _label() -> Column:
    return (F.col("o_orderpriority") == "1-URGENT").cast("int")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("compound_id"), F.col("o_custkey").alias("group_id"), _label().alias("label")
    )


def expert_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Wide: three label-related scores in [0, 1) per compound."""
    k, y = F.col("compound_id"), F.col("label")
    score = lambda factor, modulus, lift: (k * factor % modulus + lift * y).cast("double") / 1000
    return labels(spark, sf).select(
        "compound_id",
        "label",
        score(7919, 700, 300).alias("a"),
        score(104729, 800, 200).alias("b"),
        score(1299709, 900, 100).alias("c"),
    )


def expert_scores_long(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(e).alias("model"), F.col(e).alias("prob")) for e in EXPERTS])
    return expert_scores(spark, sf).select("compound_id", "label", F.explode(pairs).alias("s")).select(
        "compound_id", "label", "s.*"
    )


def adv_scores(spark: SparkSession, sf: str) -> DataFrame:
    k, g = F.col("compound_id"), F.col("group_id")
    return labels(spark, sf).withColumn(
        "adversarial_score", ((g * 31 + k * 17) % 10007).cast("double") / 10007
    )


def sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(train, new): every fifth compound plays the unlabelled new data, with another spelling."""
    all_rows = compounds_file(spark, sf).withColumnsRenamed({"alogp": "ALOGP", "mw": "MW"})
    is_new = F.col("compound_id") % 5 == 0
    new = all_rows.where(is_new).drop("label").withColumnRenamed("ALOGP", "AlogP")
    return all_rows.where(~is_new), new


def fp_bits(spark: SparkSession, sf: str) -> DataFrame:
    """2048-wide fingerprints as bit lists: positions whose count is exactly 1."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("compound_id"), (F.col("l_partkey") % 2048).cast("int").alias("bit"))
    # dealt out by compound once, for both aggregates and the join
    ones = lines.repartition("compound_id").groupBy("compound_id", "bit").agg(F.count("*").alias("v")).where("v = 1")
    bits = ones.groupBy("compound_id").agg(F.array_sort(F.collect_list("bit")).alias("bits"))
    every = table(spark, sf, "orders").select(F.col("o_orderkey").alias("compound_id"))
    return every.join(bits, "compound_id", "left")


def compound_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    third = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("-"), (key % 2253).cast("string")))
    return table(spark, sf, "part").select(
        key,
        F.concat(
            F.lit("L"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("-"),
            (key % 1000).cast("string"), F.lit("-"), (key % 77).cast("string"), third,
        ).alias("del_id"),
    )
