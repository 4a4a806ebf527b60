"""Exact dedup by content sort.

Rows are range-partitioned and sorted by their normalised text. The exchange orders by the first
characters, then by the sha256 of the whole text, so the sampled splitters stay short however long
the texts are, and by id, so a text that fills many partitions is split among them. Sorting places
equal texts next to each other and each row is compared with the one before in full. Only the first
and the last text of a partition can go on in another one; these two are settled by their sha256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import lower_ascii, pick, tasks_for
from assaykit.session import materialize

LEAD = 16  # characters in front of the digest in the sort key


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each run of equal texts with the run's size and first id; ``open`` if at an end of the partition."""
    held: list[pa.RecordBatch] = []  # ids and digests of the run that goes on
    last, first_run = None, True

    def out(part: pa.Table, starts: np.ndarray, is_open: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, part.num_rows))
        run = np.repeat(np.arange(len(starts)), sizes)
        head = np.zeros(part.num_rows, bool)
        head[starts] = True
        ids = part.column("doc_id").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [ids, part.column("sha").combine_chunks(), ids.take(pa.array(starts[run])), pa.array(sizes[run]), pa.array(head), pa.array(is_open[run])],
            ["doc_id", "sha", "run_id", "run_size", "head", "open"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        text, slim = batch.column("norm"), batch.select(["doc_id", "sha"])
        differs = np.ones(batch.num_rows, bool)
        differs[0] = last is None or text[0].as_py() != last
        differs[1:] = ~pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        last = text[-1].as_py()
        starts = np.flatnonzero(differs)
        if len(starts) == 0 or (not held and len(starts) == 1):
            held.append(slim)
            continue
        before = sum(x.num_rows for x in held)
        whole = pa.Table.from_batches([*held, slim])
        begins = np.unique(np.concatenate(([0], starts + before)))
        flags = np.zeros(len(begins) - 1, bool)
        flags[0], first_run = first_run, False
        yield out(whole.slice(0, begins[-1]), begins[:-1], flags)
        held = whole.slice(begins[-1]).to_batches()
    if held:
        yield out(pa.Table.from_batches(held), np.zeros(1, int), np.ones(1, bool))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest doc_id of a group stays; a null id comes after every other one, and of repeated rows
    with that id exactly one stays. In a group of null ids only, keep_id is null and one row stays.
    An empty table gives an empty table.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("norm"))
    rows = rows.select("doc_id", "norm", F.substring("norm", 1, LEAD).alias("lead"), F.sha2("norm", 256).alias("sha"))
    order = [F.col("lead"), F.col("sha")]
    placed = rows.repartitionByRange(tasks_for(docs), *order, F.desc_nulls_last("doc_id")).sortWithinPartitions(
        *order, "norm", F.desc_nulls_last("doc_id")
    )
    runs = placed.select("doc_id", "norm", "sha").mapInArrow(
        _runs, "doc_id bigint, sha string, run_id bigint, run_size bigint, head boolean, open boolean"
    )
    runs = materialize(runs.withColumn("part", F.spark_partition_id()), "runs")
    # one or two rows for each partition
    ends = runs.where("open and head").groupBy("sha").agg(
        F.max(F.struct(F.coalesce("run_id", F.lit(-(1 << 63))).alias("o"), "run_id", (-F.col("part")).alias("p"))).alias("win"),
        F.sum("run_size").alias("total"),
    )
    ends = ends.select(F.col("sha").alias("end_sha"), "total", F.col("win.run_id").alias("win_id"), (-F.col("win.p")).alias("win_part"))
    joined = runs.join(F.broadcast(ends), F.col("open") & (F.col("sha") == F.col("end_sha")), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("open"), F.col("win_id")).otherwise(F.col("run_id")).alias("keep_id"),
        F.when(F.col("open"), F.col("total")).otherwise(F.col("run_size")).alias("group_size"),
        (F.col("head") & (~F.col("open") | (F.col("part") == F.col("win_part")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
