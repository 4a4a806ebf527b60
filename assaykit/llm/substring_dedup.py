"""Substring dedup by level-wise doubling.

Windows are first judged at half their length. Every window of L words holds L/2 + 1 runs of half
that length; the run with the smallest hash is its anchor, and equal windows have equal anchors,
so only anchors (about one run in L/4) are counted over the corpus. Windows whose anchor occurs
in one document alone are out. The others are extended to twice the length and counted again; a
window that repeats there is removed from every document but the ones with the smallest id.
Longer levels cannot add a word, as every longer repeat is covered by windows of L words, so the
doubling stops at L.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import pick
from assaykit.llm.wordhash import Words, lists, signed, slices, sliding_min
from assaykit.session import materialize

WINDOW = 50
_EMPTY = hashlib.sha256(b"").hexdigest()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, their text, and the anchor of each: the smallest hash of its half-length runs."""
    half = (window + 1) // 2
    starts, text = w.window_starts(window)
    return starts, text, sliding_min(w.runs(half), window - half + 1)[starts]


def _profile(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                _, text, anchor = _anchors(w, window)
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("row_hash"), pa.array(w.counts.astype(np.int64)),
                        pa.array([_sha(t.split()) for t in raw]),
                        pa.array(signed(w.whole(0))), pa.array(signed(w.whole(1))),
                        lists(signed(anchor[new]), np.bincount(text[new], minlength=b - a)),
                    ],
                    ["doc_id", "row_hash", "n_words", "sha", "seq1", "seq2", "anchors"],
                )

    return run


def _extended(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                starts, text, anchor = _anchors(w, window)
                found = part.column("shared")
                sizes = np.diff(found.offsets.to_numpy())
                values = found.flatten().to_numpy(zero_copy_only=False)
                keep, at, edges = np.zeros(len(starts), bool), 0, np.searchsorted(text, np.arange(b - a + 1))
                for i, n in enumerate(sizes):
                    span = slice(edges[i], edges[i + 1])
                    keep[span] = np.isin(signed(anchor[span]), values[at : at + n])
                    at += n
                starts, text = starts[keep], text[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(w.runs(window, 1)[starts])), pa.array(signed(w.runs(window, 2)[starts])),
                        part.column("doc_id").take(pa.array(text)), part.column("row_hash").take(pa.array(text)),
                        pa.array((starts - w.first[:-1][text]).astype(np.int32)),
                    ],
                    ["w1", "w2", "doc_id", "row_hash", "pos"],
                )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for text, found in zip(batch.column("text"), batch.column("found")):
                words = (text.as_py() or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int32)
                at = np.asarray(found.values)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = [x for x, g in zip(words, gone.tolist()) if not g]
                removed.append(int(gone.sum()))
                shas.append(_sha(kept))
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "row_hash", "n_removed", "cut_sha", "kept_text"],
            )

    return run


def _parts(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profile of every row, first document of each word sequence, and the rows cut inside."""
    rows = pick(docs, "doc_id", "text").withColumn("row_hash", F.xxhash64("text"))
    profile = materialize(
        rows.mapInArrow(
            _profile(window),
            "doc_id bigint, row_hash bigint, n_words bigint, sha string, seq1 bigint, seq2 bigint, anchors array<bigint>",
        ),
        "profile",
    )
    usable = profile.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    # a document with the words of an earlier one loses them all; the windows of the earlier one speak for it
    firsts = usable.groupBy("seq1", "seq2", "n_words").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1").drop("n"), "firsts")
    reps = (
        usable.join(firsts, ["seq1", "seq2", "n_words"], "left")
        .where(F.col("first_id").isNull() | (F.col("first_id") == F.col("doc_id")))
        .select("doc_id", "row_hash", F.explode("anchors").alias("anchor"))
        .distinct()
    )
    reps = materialize(reps, "anchors")
    shared = reps.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    survivors = reps.join(shared, "anchor").groupBy("doc_id", "row_hash").agg(F.collect_set("anchor").alias("shared"))
    texts = materialize(rows.join(survivors, ["doc_id", "row_hash"]), "candidates")
    windows = materialize(
        texts.mapInArrow(_extended(window), "w1 bigint, w2 bigint, doc_id bigint, row_hash bigint, pos int"), "windows"
    )
    repeated = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    later = (
        windows.join(repeated.select("w1", "w2", "lo"), ["w1", "w2"])
        .where("doc_id > lo")
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("pos").alias("found"))
    )
    cut = texts.drop("shared").join(later, ["doc_id", "row_hash"]).mapInArrow(
        _cut(window), "doc_id bigint, row_hash bigint, n_removed bigint, cut_sha string, kept_text string"
    )
    return profile, firsts, cut


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the sha256 of the words that stay, joined by a space.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller
    doc_id. Null texts have no words. Rows with a null doc_id lose nothing and remove nothing.
    Rows sharing a doc_id never remove each other's words; equal rows get equal results. Texts
    shorter than the window stay whole. An empty table gives an empty table.
    """
    profile, firsts, cut = _parts(docs, window)
    cut = materialize(cut.drop("kept_text").dropDuplicates(["doc_id", "row_hash"]), "cut")
    copy = (F.col("first_id") < F.col("doc_id")) & (F.col("n_words") >= window)
    return (
        profile.drop("anchors")
        .join(firsts, ["seq1", "seq2", "n_words"], "left")
        .join(cut, ["doc_id", "row_hash"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
            F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        )
    )


def cut_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text) of the rows that lose words inside, with what is left of them."""
    cut = _parts(docs, window)[2]
    return cut.select("doc_id", F.col("kept_text").alias("text"))
