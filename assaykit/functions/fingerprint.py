"""Fingerprint strings (``"0,0,11,1"``) as Spark column expressions and one ML stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import VectorSizeHint
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("eq1", "count", "nonzero")
SLICE_ELEMENTS = 1 << 20  # elements of fingerprints that a Python worker parses at once


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown fingerprint mode {mode!r}; use one of {MODES}")


def fp_length(c: str | Column) -> Column:
    """Number of elements in the string; null for a null fingerprint."""
    return F.when(_col(c).isNotNull(), F.size(F.split(_col(c), ",")))


def fp_is_valid(c: str | Column, width: int) -> Column:
    """True when the fingerprint is present and has ``width`` elements."""
    return F.coalesce(fp_length(c) == F.lit(width), F.lit(False))


def parse_strict(c: str | Column, element_type: str = "int") -> Column:
    """String to integers; a malformed element fails the job, as does overflow of ``tinyint``."""
    return F.split(_col(c), ",").cast(f"array<{element_type}>")


def parse_lenient(c: str | Column) -> Column:
    """String to integers, null when any element is malformed."""
    parsed = _col(c).try_cast("string")
    parsed = F.split(parsed, ",").try_cast("array<int>")
    return F.when(~F.exists(parsed, lambda v: v.isNull()), parsed)


def _as_mode(v: Column, mode: str) -> Column:
    if mode == "eq1":
        return (v == 1).cast("int")
    if mode == "nonzero":
        return (v != 0).cast("int")
    return v


def encode(c: str | Column, width: int, mode: str = "eq1") -> Column:
    """Dense ``array<int>`` of exactly ``width``; null or wrong-length input gives all zeros."""
    _check_mode(mode)
    values = parse_strict(c)
    if mode != "count":
        values = F.transform(values, lambda v: _as_mode(v, mode))
    return F.when(fp_is_valid(c, width), values).otherwise(F.array_repeat(F.lit(0), width))


def on_positions(c: str | Column, width: int, mode: str = "eq1") -> Column:
    """Positions that are on, ascending; empty for null or wrong-length input."""
    _check_mode(mode)
    wanted = (lambda v: v == 1) if mode == "eq1" else (lambda v: v != 0)
    flagged = F.transform(
        parse_strict(c), lambda v, i: F.when(wanted(v), i)
    )
    return F.when(fp_is_valid(c, width), F.array_compact(flagged)).otherwise(
        F.array().cast("array<int>")
    )


def pad_or_truncate(values: Column, width: int) -> Column:
    """Bring an integer array to ``width`` with trailing zeros or by cutting the tail."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0), width)), 1, width)


def concat_blocks(blocks: list[Column]) -> Column:
    """Place several fingerprint blocks side by side."""
    return F.concat(*blocks)


def modal_widths(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Most frequent length per fingerprint column (longer wins a tie); one small aggregate."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("c"), fp_length(c).alias("w")) for c in cols])
    )
    counts = df.select(pairs.alias("p")).where("p.w IS NOT NULL").groupBy("p.c", "p.w").count()
    best = counts.groupBy("c").agg(F.max(F.struct("count", "w")).alias("best")).select("c", "best.w")
    found = {r["c"]: int(r["w"]) for r in best.collect()}
    missing = [c for c in cols if c not in found]
    if missing:
        raise ValueError(f"no fingerprint text found in column(s) {missing}")
    return found


def sized(df: DataFrame, col: str, size: int) -> DataFrame:
    """Declare the length of a vector column; the values are not checked."""
    return VectorSizeHint(inputCol=col, size=size, handleInvalid="optimistic").transform(df)


def _text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a batch of texts; a null is an empty text."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parse_batch(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, value) of the elements other than 0, in order, of the texts with ``width`` elements.

    Null texts and those of another length have none; an element that is no integer of at most 18 digits raises.
    Texts of single digits, the usual ones, are rows of a matrix of bytes; all others go the general way.
    """
    data, offsets = _text_buffers(texts)
    size = np.diff(offsets)
    fits = size == 2 * width - 1
    matrix = (data if fits.all() else data[np.repeat(fits, size)]).reshape(-1, 2 * width - 1)
    digits = matrix[:, ::2] - np.uint8(48)
    simple = (matrix[:, 1::2] == 44).all(axis=1) & (digits <= 9).all(axis=1)
    rows = np.flatnonzero(fits)[simple]
    digits = digits if simple.all() else digits[simple]
    row, position = np.nonzero(digits)
    found = rows[row], position, digits[row, position].astype(np.int64)
    rest = np.ones(len(texts), bool)
    rest[rows] = False
    if not rest.any():
        return found
    others = np.flatnonzero(rest)
    row, *more = _parse_mixed(texts.take(pa.array(others)), width)
    joined = [np.concatenate(pair) for pair in zip(found, (others[row], *more))]
    order = np.argsort(joined[0], kind="stable")
    return tuple(x[order] for x in joined)


def _parse_mixed(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``parse_batch``, for elements of any length: separators give the elements of the whole buffer, and only
    those longer than one digit are read digit by digit."""
    data, offsets = _text_buffers(texts)
    comma = np.flatnonzero(data == 44)
    lengths = np.diff(np.searchsorted(comma, offsets)) + 1
    right = (lengths == width) & np.asarray(texts.is_valid().to_numpy(zero_copy_only=False))
    rows = np.flatnonzero(right)
    first = np.searchsorted(comma, offsets[:-1])[rows]
    inner = comma[first[:, None] + np.arange(width - 1)]
    starts = np.hstack([offsets[rows][:, None], inner + 1]).ravel()
    ends = np.hstack([inner, offsets[rows + 1][:, None]]).ravel()

    def check(good: np.ndarray) -> None:
        if not good.all():
            at = rows[int(np.argmin(good)) // width]
            raise ValueError(f"malformed fingerprint {bytes(data[offsets[at] : offsets[at + 1]])[:80].decode(errors='replace')!r}")

    check(ends > starts)
    values = data[starts].astype(np.int64) - 48
    single = ends - starts == 1
    check(~single | ((values >= 0) & (values <= 9)))
    at = np.flatnonzero(~single)
    if len(at):
        values[at] = _long_elements(data, starts[at], ends[at], lambda good: check(_spread(good, at, len(values))))
    on = np.flatnonzero(values)
    return rows[on // width], on % width, values[on]


def _spread(good: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    every = np.ones(n, bool)
    every[at] = good
    return every


def _long_elements(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, check: Callable[[np.ndarray], None]) -> np.ndarray:
    """Values of elements with a sign, spaces around them, or several digits; one step per place."""
    starts, ends = starts.copy(), ends.copy()
    space = lambda at: (data[at] == 32) | ((data[at] >= 9) & (data[at] <= 13))
    while (more := (ends > starts) & space(np.minimum(starts, len(data) - 1))).any():
        starts += more
    while (more := (ends > starts) & space(ends - 1)).any():
        ends -= more
    check(ends > starts)
    negative = data[starts] == 45
    starts += negative | (data[starts] == 43)
    check((ends > starts) & (ends - starts <= 18))
    values = np.zeros(len(starts), np.int64)
    for place in range(int((ends - starts).max())):
        left = starts + place < ends
        digit = data[np.minimum(starts + place, len(data) - 1)].astype(np.int64) - 48
        check(~left | ((digit >= 0) & (digit <= 9)))
        values = np.where(left, values * 10 + digit, values)
    return np.where(negative, -values, values)


def _vector_encoder(widths: list[int], mode: str) -> Callable[..., Column]:
    """Texts of a batch to sparse vectors, without a Python call or object per row."""
    starts = np.concatenate(([0], np.cumsum(widths)))
    fields = [pa.field("type", pa.int8(), False), pa.field("size", pa.int32())]
    fields += [pa.field(n, pa.list_(pa.field("element", t, False))) for n, t in (("indices", pa.int32()), ("values", pa.float64()))]

    # a slice of a batch at a time: working arrays take some 60 bytes an element
    step = max(1, SLICE_ELEMENTS // max(1, sum(widths)))

    def encode_slice(texts: tuple[pa.Array, ...]) -> pa.Array:
        n = len(texts[0])
        found = [parse_batch(t, w) for t, w in zip(texts, widths)]
        row = np.concatenate([f[0] for f in found])
        index = np.concatenate([f[1] + s for f, s in zip(found, starts)])
        value = np.concatenate([f[2] for f in found])
        if mode == "eq1":
            row, index, value = (x[value == 1] for x in (row, index, value))
        if mode != "count":
            value = np.ones(len(value))
        order = np.argsort(row, kind="stable")  # columns in turn, each in order
        offsets = pa.array(np.searchsorted(row[order], np.arange(n + 1)), pa.int32())
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(x[order], f.type.value_type), f.type)
            for x, f in ((index, fields[2]), (value, fields[3]))
        ]
        parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, starts[-1], np.int32)), *lists]
        return pa.StructArray.from_arrays(parts, fields=fields)

    def encode_batch(texts: tuple[pa.Array, ...]) -> pa.Array:
        return pa.concat_arrays([encode_slice(tuple(t.slice(i, step) for t in texts)) for i in range(0, max(1, len(texts[0])), step)])

    def one(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return (encode_batch((c,)) for c in columns)

    def several(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return map(encode_batch, columns)

    return F.arrow_udf(one if len(widths) == 1 else several, VectorUDT())


class FingerprintEncoder(
    Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """ML stage: fingerprint strings to one sparse vector, blocks in the order of ``inputCols``.

    ``onMissing='zero'`` fills the block of an absent column in place, so later blocks keep
    their positions; the default raises.
    """

    widths = Param(Params._dummy(), "widths", "elements per input column", TypeConverters.toListInt)
    mode = Param(Params._dummy(), "mode", "eq1, count or nonzero", TypeConverters.toString)
    onMissing = Param(Params._dummy(), "onMissing", "error or zero", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, widths=None, mode="eq1", onMissing="error"):
        super().__init__()
        self._setDefault(mode="eq1", onMissing="error")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        mode = self.getOrDefault(self.mode)
        _check_mode(mode)
        cols, widths = self.getInputCols(), self.getOrDefault(self.widths)
        missing = [c for c in cols if c not in df.columns]
        if missing and self.getOrDefault(self.onMissing) == "error":
            raise ValueError(f"fingerprint column(s) missing: {missing}")
        texts = [F.lit(None).cast("string") if c in missing else F.col(c) for c in cols]
        encoded = df.withColumn(self.getOutputCol(), _vector_encoder(widths, mode)(*texts))
        # a declared size spares later stages a look at the first row, which a stream cannot give
        return sized(encoded, self.getOutputCol(), sum(widths))
