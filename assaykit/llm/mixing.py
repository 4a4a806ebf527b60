"""Mixing sources to target weights.

Every document gets a random key that is a hash of its id. The key space of each source is cut into
equal ranges of a bounded number of rows, so the ranges are already in order; a range is sorted in one
task, and the totals of the ranges before it give the prefix sum of words. Documents in front of the
source's budget are taken, whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import WORD, pick
from assaykit.operators.ordered import global_rank
from assaykit.session import broadcast_if_small, materialize

WEIGHTS = (5, 2, 1)
ROWS_PER_RANGE = 50_000
_KEY_SPACE = 1 << 32


def _slim(docs: DataFrame) -> DataFrame:
    rows = pick(docs, "doc_id", "source", "text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return rows.select("doc_id", "source", size.alias("size"), _key(F.col("doc_id")).alias("key"))


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def _targets(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: its number, size, weight, target and words to take.

    Sources above twice their size are held there and the excess is shared again by weight. The
    share of a weight only rises, so each round needs no more than the last round's two sums.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = global_rank(sums, [F.col("source").asc_nulls_last()], "source_no", start=0)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = materialize(ranked.withColumn("weight", weight.cast("bigint")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full, rest, weight_sum = F.lit(False), 0, 1
    done = -1
    while True:
        n_full, held, free = sources.agg(
            F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n_full == done or not free:
            break
        # words to share are halves: 3 * total / 2, less 2 * size of the sources that are full
        done, rest, weight_sum = n_full, 3 * total - 4 * (held or 0), free
        full = F.col("weight") * F.lit(rest) > 4 * F.col("source_size") * F.lit(weight_sum)
    share = F.col("weight") * F.lit(rest)
    return sources.select(
        "source",
        "source_no",
        "source_size",
        "n_docs",
        F.when(full, 2.0 * F.col("source_size")).otherwise(share / F.lit(2 * weight_sum)).cast("double").alias("target"),
        F.when(full, 2 * F.col("source_size")).otherwise(F.expr(f"weight * {rest}L div {2 * weight_sum}L")).alias("words"),
    )


def _placed(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Every document with its source's plan and the words of the same source in front of it."""
    sources = materialize(_targets(rows, weights), "targets")
    spread = F.expr(f"n_docs div {ROWS_PER_RANGE} + 1")
    numbered = rows.join(broadcast_if_small(sources.withColumn("n_ranges", spread)), rows.source.eqNullSafe(sources.source)).drop(sources.source)
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    numbered = numbered.withColumn("at", at).withColumn("part", F.expr(f"at * n_ranges div {_KEY_SPACE}")).drop("at", "n_ranges", "n_docs")
    totals = numbered.groupBy("source_no", "part").agg(F.sum("size").alias("in_part"))
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select("source_no", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("off")), "offsets")
    inside = Window.partitionBy("source_no", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        numbered.join(broadcast_if_small(offsets), ["source_no", "part"])
        .withColumn("before", F.col("off") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0))
        .withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row: doc_id, size, source_size, target and taken, the words that the mix takes of it.

    Sources by code point, null last, weigh ``weights`` in turn and share 150 % of all words; a
    source gets 2 times its size at most. The document on a source's budget is taken in part, so the
    words of a source are its target rounded down. Null and empty texts have size 0 and take 0; if no
    document has words every target is 0. Null ids share one key; rows with equal id and size are
    alike, so ties can't change the result. An empty table gives an empty table.
    """
    rows = materialize(_slim(docs), "sizes")
    taken = F.col("size") * F.col("epochs") + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    return _placed(rows, weights).select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents of the mix, repeated by epoch, with the columns of ``docs``.

    The document on a source's budget stays whole, so a source exceeds its target by less than one
    document. The texts are not shuffled: the cut of a source is one key, and every document is
    compared with it.
    """
    rows = materialize(_slim(docs), "sizes")
    placed = _placed(rows, weights)
    place = F.struct("key", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size")
    cuts = placed.groupBy("source").agg(
        F.max("epochs").alias("epochs"), F.max(F.when(F.col("before") < F.col("rest"), place)).alias("cut")
    )
    cuts = materialize(cuts.select(F.col("source").alias("cut_source"), "epochs", "cut"), "cuts")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, source, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "source", "text"))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    own = F.struct(_key(doc_id).alias("key"), doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("id"), size.alias("size"))
    joined = plain.join(broadcast_if_small(cuts), source.eqNullSafe(F.col("cut_source")))
    copies = F.when(size > 0, F.col("epochs") + F.coalesce((own <= F.col("cut")).cast("int"), F.lit(0))).otherwise(0)
    repeated = joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return repeated.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS BIGINT) AS weight
  FROM d GROUP BY source),
-- sources fill up in the order of size over weight: the first prefix after which the next one does not
f AS (
  SELECT *, sum(source_size) OVER up AS held, sum(weight) OVER (ORDER BY source_size / weight DESC, source DESC NULLS FIRST) AS free,
    sum(source_size) OVER () AS total
  FROM s WINDOW up AS (ORDER BY source_size / weight, source NULLS LAST)),
g AS (
  SELECT *, CAST(weight * (3 * total - 4 * (held - source_size)) > 4 * source_size * free AS INT) AS is_full FROM f),
h AS (
  SELECT CAST(coalesce(sum(source_size) FILTER (WHERE is_full = 1), 0) AS BIGINT) AS held,
    CAST(sum(weight) FILTER (WHERE is_full = 0) AS BIGINT) AS free, CAST(max(total) AS BIGINT) AS total FROM g),
t AS (
  SELECT source, source_size,
    CASE WHEN is_full = 1 THEN 2.0::DOUBLE * source_size ELSE CAST(weight * (3 * h.total - 4 * h.held) AS DOUBLE) / CAST(2 * h.free AS DOUBLE) END AS target,
    CASE WHEN is_full = 1 THEN 2 * source_size ELSE weight * (3 * h.total - 4 * h.held) // (2 * h.free) END AS words
  FROM g, h),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * epochs + greatest(0, least(size, words - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
