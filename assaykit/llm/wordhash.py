"""Words of a batch of texts as numpy arrays, and hashes of runs of words.

Works on the UTF-8 buffer of an Arrow column, a bounded slice of rows at a time, so that memory
follows the slice and not the batch. A hash of a run is a difference of two prefix sums of a
polynomial modulo 2^64, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
# odd multipliers and their inverses modulo 2^64
_BASES = tuple((b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    p = np.full(1 << bits, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _power_table(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    bits = max(16, int(n).bit_length())
    return _powers(_BASES[which][0], bits)[: n + 1], _powers(_BASES[which][1], bits)[: n + 1]


def _prefix(values: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_table(len(values), which)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


class Words:
    """The words of some consecutive texts: byte spans, hashes, and where each text begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        sep = _SEPARATOR[data]
        before = np.concatenate(([True], sep[:-1])) if len(sep) else sep.copy()
        after = np.concatenate((sep[1:], [True])) if len(sep) else sep.copy()
        inside = offsets[(offsets > 0) & (offsets < len(data))]
        before[inside] = True
        after[inside - 1] = True
        self.starts = np.flatnonzero(~sep & before)
        self.ends = np.flatnonzero(~sep & after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and one past the last
        self.counts = np.diff(self.first)
        sums, down = _prefix((_BYTE_LOWER if lower else _BYTE)[data], 0)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _words(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in self._sums:
            self._sums[which] = _prefix(self.hashes, which)
        return self._sums[which]

    def runs(self, k: int, which: int = 0) -> np.ndarray:
        """Hash of the k words from each position on, also across texts (see ``window_starts``)."""
        sums, down = self._words(which)
        n = max(0, len(self.hashes) - k + 1)
        return mix((sums[k : k + n] - sums[:n]) * down[:n])

    def whole(self, which: int = 0) -> np.ndarray:
        """Hash of all words of each text."""
        sums, down = self._words(which)
        a, b = self.first[:-1], self.first[1:]
        return mix((sums[b] - sums[a]) * down[a] + self.counts.astype(np.uint64))

    def window_starts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where k words of one text begin, and the text of each."""
        n = np.maximum(self.counts - k + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        return self.first[:-1][text] + ranges(n), text


def ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ... counts[1]-1, ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def text_column(column: pa.Array) -> pa.Array:
    """The texts as one array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def slices(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) over consecutive rows of at most ``most`` bytes, one row at least."""
    texts = text_column(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column of int64 out of its values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))
