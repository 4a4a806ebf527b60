"""Leak-free splits. All of them order by md5, so the same seed gives the same split anywhere."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.operators.joins import attach_by_key
from assaykit.operators.ordered import exact_quantiles, global_rank, rank_within
from assaykit.session import materialize

# Distinct (positives, negatives) of groups that one task deals; the next block starts from its totals.
PROFILES_PER_BLOCK = 50_000


def seeded_order(c: str, seed: int) -> Column:
    """Pseudo-random but repeatable sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(c).cast("string")))


def fold_count(test_size: float) -> int:
    return math.ceil(1.0 / test_size)


def _greedy_seats(k: int, positives: int, negatives: int, taken: list[tuple[int, int]]):
    """A function from profiles of groups to the fold of each group that is left over.

    ``taken`` holds the positives and negatives that the left-over groups of earlier blocks brought to
    each fold. A group goes where it adds least to the sum over both classes of the squared shares of
    the folds; ties go to the fold with fewer rows, then to the first. All in exact integers.
    """

    def run(block: pa.Table) -> pa.Table:
        load = [list(t) for t in taken]
        rows = sorted(block.select(["n1", "n0", "groups"]).to_pylist(), key=lambda r: (-(r["n1"] + r["n0"]), -r["n1"]))
        for r in rows:
            a, b = r["n1"] * negatives**2, r["n0"] * positives**2
            r["seats"] = []
            for _ in range(r["groups"] % k):
                best = min(range(k), key=lambda f: (load[f][0] * a + load[f][1] * b, load[f][0] + load[f][1]))
                load[best][0] += r["n1"]
                load[best][1] += r["n0"]
                r["seats"].append(best)
        return pa.Table.from_pylist(rows, pa.schema([("n1", pa.int64()), ("n0", pa.int64()), ("groups", pa.int64()), ("seats", pa.list_(pa.int32()))]))

    return run


def _dealt(stats: DataFrame, k: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Seats of the left-over groups of every profile (n1, n0), and the rows of each fold by class.

    Groups of one profile are alike, so all but ``groups % k`` of them are dealt evenly. The left-over
    ones are dealt from the largest profile down. Profiles are far fewer than groups; they come in
    blocks, each one task, and only the k running totals pass from block to block.
    """
    spark = stats.sparkSession
    profiles = stats.groupBy("n1", "n0").agg(F.count("*").alias("groups"))
    ranked = global_rank(profiles, [F.desc(F.col("n1") + F.col("n0")), F.desc("n1")], "at", start=0)
    ranked = materialize(ranked.withColumn("block", F.floor(F.col("at") / PROFILES_PER_BLOCK)), "profiles")
    whole = F.floor(F.col("groups") / k).cast("long")
    total = lambda c: F.coalesce(F.sum(F.col(c)), F.lit(0))
    n_blocks, positives, negatives, even1, even0 = ranked.agg(
        F.coalesce(F.max("block") + 1, F.lit(0)),
        *[F.coalesce(F.sum(F.col(c) * F.col("groups")), F.lit(0)) for c in ("n1", "n0")],
        *[F.coalesce(F.sum(F.col(c) * whole), F.lit(0)) for c in ("n1", "n0")],
    ).first()
    taken, seats = [(0, 0)] * k, []
    for block in range(n_blocks):
        dealt = ranked.where(F.col("block") == block).groupBy("block").applyInArrow(
            _greedy_seats(k, positives, negatives, taken), "n1 long, n0 long, groups long, seats array<int>"
        )
        dealt = materialize(dealt, "seats")
        added = dealt.select(F.explode("seats").alias("fold"), "n1", "n0").groupBy("fold").agg(total("n1"), total("n0"))
        more = {f: (a, b) for f, a, b in added.collect()}  # k rows
        taken = [(a + more.get(f, (0, 0))[0], b + more.get(f, (0, 0))[1]) for f, (a, b) in enumerate(taken)]
        seats.append(dealt)
    table = reduce(DataFrame.unionAll, seats) if seats else spark.createDataFrame([], "n1 long, n0 long, groups long, seats array<int>")
    return table, [(even1 + a, even0 + b) for a, b in taken]


def _deal_groups(df: DataFrame, group: str, positives: Column, k: int, seed: int, fold: str) -> DataFrame:
    """Adds ``fold``: whole groups, dealt so that the folds are even in rows and in positives.

    Which groups of a profile are left over is drawn by a seeded hash. Fold 0 is the fold whose number
    of rows is nearest to an even share, so that a hold-out has the size that was asked for.
    """
    if k < 2:
        raise ValueError("two folds at least")
    stats = df.groupBy(group).agg(F.coalesce(F.sum(positives), F.lit(0)).alias("n1"), F.count("*").alias("__n"))
    stats = materialize(stats.withColumn("n0", F.col("__n") - F.col("n1")), "groups")
    seats, loads = _dealt(stats, k)
    n = sum(a + b for a, b in loads)
    order = sorted(range(k), key=lambda f: (abs(k * sum(loads[f]) - n), hashlib.md5(f"{seed}|{f}".encode()).hexdigest()))
    number = F.array(*[F.lit(order.index(f)) for f in range(k)])
    ranked = rank_within(stats, ["n1", "n0"], [seeded_order(group, seed), F.col(group)], "__rank")
    # many groups may share a profile: its seats reach them as any hot key's values do
    placed = attach_by_key(
        ranked.withColumn("__profile", F.struct("n1", "n0")),
        seats.select(F.struct("n1", "n0").alias("__profile"), "groups", "seats"), "__profile", "groups", ["seats"],
    )
    seat, left = F.col("__rank") - 1, F.size("seats")
    raw = F.when(seat < left, F.get("seats", seat.cast("int"))).otherwise(((seat - left) % k).cast("int"))
    folds = materialize(placed.select(group, "__n", F.get(number, raw).alias(fold)), "folds")
    return attach_by_key(df, folds, group, "__n", [fold])


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 42, fold: str = "fold") -> DataFrame:
    """Deal whole groups to ``k`` folds that are alike in rows and in positives, also if some groups are large.

    Fold 0, the hold-out, is the fold nearest to an even share of the rows.
    """
    return _deal_groups(df, group, (F.col(label) == 1).cast("long"), k, seed, fold)


def balanced_group_folds(df: DataFrame, group: str, k: int, seed: int = 42, fold: str = "fold") -> DataFrame:
    """Deal whole groups, the largest first, each to the fold that has the fewest rows so far."""
    return _deal_groups(df, group, F.lit(0).cast("long"), k, seed, fold)


def group_holdout(df: DataFrame, group: str, label: str, test_size: float, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: one of ceil(1/test_size) stratified group folds."""
    folds = stratified_group_folds(df, group, label, fold_count(test_size), seed, "__fold")
    return folds.withColumn("is_test", F.col("__fold") == 0).drop("__fold")


def stratified_halves(df: DataFrame, id_col: str, label: str, seed: int = 42, half: str = "half") -> DataFrame:
    """Split rows 50/50 inside each class: every second row of a seeded order."""
    ranked = rank_within(df, [label], [seeded_order(id_col, seed), F.col(id_col)], "__rank")
    return ranked.withColumn(half, ((F.col("__rank") - 1) % 2).cast("int")).drop("__rank")


def percentile_cut(df: DataFrame, score: str, q: float) -> DataFrame:
    """Exact ``q`` percentile (0..1) of a score as a one-row table."""
    return exact_quantiles(df, score, {"cut": q})


def adversarial_split(df: DataFrame, score: str, test_size: float) -> DataFrame:
    """Adds ``is_test`` for the rows with the top ``test_size`` share of scores, ties included."""
    checked = F.when(
        F.col(score).isNull() | F.isnan(score), F.raise_error(F.lit("null or NaN adversarial score"))
    ).otherwise(F.col(score))
    cut = percentile_cut(df, score, 1.0 - test_size).first()["cut"]
    if cut is None:
        raise ValueError(f"no value in {score!r} to split on")
    return df.withColumn("is_test", checked >= F.lit(cut))


def split_report(df: DataFrame, score: str, is_test: str = "is_test") -> DataFrame:
    """Rows and score range per side."""
    return df.groupBy(is_test).agg(
        F.count("*").alias("n"), F.min(score).alias("min_score"), F.max(score).alias("max_score")
    )
