"""Fill-in-the-middle by secondary-sort assembly.

A row is cut into units and its segments (prefix, middle, suffix) into pieces of a bounded size, each
keyed by the row and by where it stands in the output. One exchange brings the pieces of a row
together in output order, where they stream into an incremental digest. Sorting the same partitions
again by the place that the markers give each piece in the source streams them into the digest of the
restored text; no second exchange moves them. No task ever joins a whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import pick, tasks_for

# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PIECE_BYTES = 1 << 14
_SOURCE_PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_PIECES = "row bigint, doc_id bigint, at bigint, content binary, n bigint, form string, prefix_chars bigint, middle_chars bigint"
_PLACED = "row bigint, doc_id bigint, region int, at bigint, content binary, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string"
_DIGESTS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
_TEXTS = "doc_id bigint, n bigint, form string, text string"


@dataclass(frozen=True)
class Choice:
    """How rows are drawn: ``seed`` begins the hashed string, shares are in per cent."""

    seed: str = "7:"
    fim_percent: int = 100
    spm_percent: int = 50
    unit: str = "line"


def unit_ends(data: np.ndarray, unit: str) -> np.ndarray:
    """Byte offsets at which the units of a text end, for ``unit`` 'line' (with its line feed) or 'char'."""
    if unit == "char":
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        return np.append(starts[1:], len(data)) if len(starts) else starts
    if unit != "line":
        raise ValueError(f"unknown unit {unit!r}")
    ends = np.flatnonzero(data == 10) + 1
    return ends if not len(data) or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _cut(raw: bytes, doc_id: int | None, how: Choice) -> tuple[int, str, int | None, int | None, list[tuple[bytes, bytes]]]:
    """Units, form, code points of prefix and middle, and (marker, segment) in output order."""
    data = np.frombuffer(raw, np.uint8)
    ends = unit_ends(data, how.unit)
    n = len(ends)
    digest = hashlib.sha256(f"{how.seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not raw or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= how.fim_percent:
        return n, "plain", None, None, [(b"", raw)]
    form = "spm" if h4 % 100 < how.spm_percent else "psm"
    edges = np.concatenate(([0], ends))
    a, b = (int(edges[i]) for i in sorted((h1 % (n + 1), h2 % (n + 1))))
    segment = {PREFIX: raw[:a], MIDDLE: raw[a:b], SUFFIX: raw[b:]}
    return n, form, _chars(data[:a]), _chars(data[a:b]), [(m, segment[m]) for m in _ORDER[form]]


def _pieces(raw: bytes, ends: int) -> Iterator[bytes]:
    """``raw`` in pieces of about ``ends`` bytes, never cut inside a code point; one piece at least."""
    at = 0
    while len(raw) - at > ends:
        to = at + ends
        while to > at and raw[to] & 0xC0 == 0x80:
            to -= 1
        yield raw[at:to]
        at = to
    yield raw[at:]


def fim_pieces(docs: DataFrame, how: Choice = Choice()) -> DataFrame:
    """The pieces of every row's output: row, doc_id, at (from 0), content, n, form and lengths.

    Joining ``content`` in the order of ``at`` gives a row's output. The first piece of a segment
    begins with its marker. ``row`` tells rows apart, also equal ones; it comes from a row's place in
    the partitions of ``docs``, which a table that is read gives again if a task runs twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: list[tuple] = []
                for row, doc, text in zip(*(part.column(c) for c in ("row", "doc_id", "text"))):
                    raw = text.cast(pa.binary()).as_py() if text.is_valid else b""
                    n, form, p, m, segments = _cut(raw, doc.as_py(), how)
                    row, doc, at = row.as_py(), doc.as_py(), 0
                    for marker, segment in segments:
                        for i, piece in enumerate(_pieces(segment, PIECE_BYTES)):
                            out.append((row, doc, at, piece if i else marker + piece, n, form, p, m))
                            at += 1
                yield _batch(out, _PIECES)

    rows = pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, _PIECES)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds)], list(names))


def _together(pieces: DataFrame) -> DataFrame:
    """Repartitioned by row and sorted within partitions by the place in the output."""
    return pieces.repartition(tasks_for(pieces), F.xxhash64("row")).sortWithinPartitions("row", "at")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest the output of each row, and give each of its pieces the place that markers and form tell.

    A last row without content carries the digest of the output.
    """
    row, told, sha, region = None, (), None, 0
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            if r["row"] != row:
                if sha is not None:
                    out.append((row, told[0], 3, 0, None, *told[1:], sha.hexdigest()))
                row, told, sha, region = r["row"], (r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"]), hashlib.sha256(), 0
            content = r["content"]
            sha.update(content)
            if r["form"] != "plain" and content[:3] in _SOURCE_PLACE:
                region, content = _SOURCE_PLACE[content[:3]], content[3:]
            if content:
                out.append((row, r["doc_id"], region, r["at"], content, None, None, None, None, None))
        yield _batch(out, _PLACED)
    if sha is not None:
        yield _batch([(row, told[0], 3, 0, None, *told[1:], sha.hexdigest())], _PLACED)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            if r["region"] < 3:
                sha.update(r["content"])
            else:
                out.append((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], sha.hexdigest()))
                sha = hashlib.sha256()
        yield _batch(out, _DIGESTS)


def fim_digests(docs: DataFrame, how: Choice = Choice()) -> DataFrame:
    """Per row: doc_id, n units, form, prefix_chars, middle_chars, output_sha256 and restored_sha256.

    Null texts count as empty: no units, form plain, and the digests of nothing. A null doc_id hashes
    as the seed alone. Equal rows each give a row with equal values; columns beside doc_id and text
    are not read; an empty table gives an empty table. Very long texts move as pieces of 16 KB.
    """
    placed = _together(fim_pieces(docs, how)).mapInArrow(_place, _PLACED)
    # the pieces of a row are still in one partition, so that sorting it anew is enough
    return placed.sortWithinPartitions("row", "region", "at").mapInArrow(_restored, _DIGESTS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One text out of the consecutive pieces of each row."""
    row, told, held = None, (), []

    def done() -> tuple:
        return (*told, b"".join(held).decode())

    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            if r["row"] != row:
                if held:
                    out.append(done())
                row, told, held = r["row"], (r["doc_id"], r["n"], r["form"]), []
            held.append(r["content"])
        yield _batch(out, _TEXTS)
    if held:
        yield _batch([done()], _TEXTS)


def fim_documents(docs: DataFrame, how: Choice = Choice()) -> DataFrame:
    """(doc_id, n, form, text) with the output text of every row; odd rows as in ``fim_digests``."""
    return _together(fim_pieces(docs, how)).mapInArrow(_joined, _TEXTS)


def restore_documents(outputs: DataFrame) -> DataFrame:
    """(doc_id, text) with the source text of rows of (doc_id, form, text) as ``fim_documents`` gives.

    The form tells the order of the markers, and each segment ends where the next marker begins.
    Plain texts come back as they are; null texts count as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    after = lambda marker: F.substring_index(text, marker, -1)
    before = lambda part, marker: F.substring_index(part, marker, 1)
    psm = F.concat(before(after("<P>"), "<S>"), after("<M>"), before(after("<S>"), "<M>"))
    spm = F.concat(before(after("<P>"), "<M>"), after("<M>"), before(after("<S>"), "<P>"))
    rows = pick(outputs, "doc_id", "form", "text")
    return rows.select("doc_id", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text).alias("text"))


FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units, CAST(concat('0x', substr(h, 1, 8)) AS UBIGINT) AS h1,
  CAST(concat('0x', substr(h, 9, 8)) AS UBIGINT) AS h2, CAST(concat('0x', substr(h, 17, 8)) AS UBIGINT) AS h3,
  CAST(concat('0x', substr(h, 25, 8)) AS UBIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n, CAST(least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS a,
  CAST(greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS x FROM c)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', x, '<M>', m) ELSE concat('<S>', x, '<P>', p, '<M>', m) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s"""
