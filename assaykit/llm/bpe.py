"""BPE encoding and decoding by forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can't be merged over, so a cut
between the two is certain. The pieces that the tokenizer's pattern makes are cut there, each
fragment is merged on its own, and the ids are put together. Pieces and fragments that were seen
before are looked up.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from assaykit.llm.common import pick

# Fixed values of the byte-level format: the pattern that splits a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_CACHED = 400_000  # results of each kind in a worker, about 70 MB
_BLOCK = 50_000  # pieces of a text that are held at once


def _byte_of() -> dict[str, int]:
    """The format writes a printable byte as itself and numbers the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Tables of one byte-level BPE vocabulary file, and the pieces seen so far."""

    def __init__(self, raw: bytes, most_cached: int = MOST_CACHED):
        self.most_cached = most_cached
        spec = json.loads(raw)
        model, byte_of = spec["model"], _byte_of()
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in ids.items():
            self.tokens[i] = token
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.single = [ids.get(bytes([b])) for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.merge[ids[left], ids[right]] = (rank, ids[left + right])
        self.joined = np.zeros((256, 256), bool)
        for token in ids:
            b = np.frombuffer(token, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.pattern = regex.compile(PIECES)
        self.splitter = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.fragments: dict[bytes, bytes] = {}
        self.pieces = _Lookup(self._piece, most_cached)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        b = np.frombuffer(raw, np.uint8)
        cuts = np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1
        if not len(cuts):
            return self._fragment(raw)
        edges = [0, *cuts.tolist(), len(raw)]
        return b"".join(self._fragment(raw[i:j]) for i, j in zip(edges, edges[1:]))

    def _fragment(self, raw: bytes) -> bytes:
        found = self.fragments.get(raw)
        if found is None:
            ids = self._merged([self.single[b] for b in raw])
            found = pack(f"<{len(ids)}I", *ids)
            if len(raw) <= 64:
                if len(self.fragments) >= self.most_cached:
                    self.fragments.clear()
                self.fragments[raw] = found
        return found

    def _merged(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        merge = self.merge
        if len(ids) <= 32:
            while len(ids) > 1:
                best, at = None, -1
                for i, pair in enumerate(zip(ids, ids[1:])):
                    found = merge.get(pair)
                    if found and (best is None or found < best):
                        best, at = found, i
                if best is None:
                    break
                ids[at : at + 2] = [best[1]]
            return ids
        right = list(range(1, len(ids))) + [-1]
        left = list(range(-1, len(ids) - 1))
        heap = [(*found, i) for i, pair in enumerate(zip(ids, ids[1:])) if (found := merge.get(pair))]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            j = right[i] if ids[i] >= 0 else -1
            if j < 0 or merge.get((ids[i], ids[j]), (0, -1))[1] != new:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (found := merge.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, found[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += [self._plain(text[at : m.start()]), pack("<I", self.special[m.group()])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:] if at else text)])

    def _plain(self, text: str) -> bytes:
        if len(text) <= 1 << 20:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while block := list(islice(found, _BLOCK)):
            out.append(b"".join(map(self.pieces.__getitem__, block)))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


class _Lookup(dict):
    """Results by argument, begun anew when full; long arguments are not kept."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(raw: bytes, most_cached: int = MOST_CACHED) -> Codec:
    """One codec for each vocabulary and Python worker."""
    name = hashlib.sha256(raw).hexdigest(), most_cached
    if name not in _CODECS:
        _CODECS[name] = Codec(raw, most_cached)
    return _CODECS[name]


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, a megabyte or two, sent once to each executor."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str, most_cached: int = MOST_CACHED) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (array of int) of each whole text.

    Null and empty texts have no ids. ``path`` names the vocabulary file, ``most_cached`` bounds the results
    that a worker keeps of either kind, which other stages find taken when workers are reused. A column of ``docs`` with
    one of the two names is replaced; other columns stay as they are.
    """
    vocabulary = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(vocabulary.value, most_cached)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [np.frombuffer(tables.encode(t or ""), "<u4").astype(np.int32) for t in part.column(at).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(n), flat], [*part.schema.names[:at], "n_tokens", "ids"])

    keep = [i for i, c in enumerate(docs.columns) if c not in ("n_tokens", "ids")]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    plain = plain.select(*[f"c{i}" for i in keep], F.col(f"c{docs.columns.index('text')}").alias("__text"))

    schema = StructType(plain.schema.fields[:-1]).add("n_tokens", LongType()).add("ids", ArrayType(IntegerType()))
    return plain.mapInArrow(run, schema).toDF(*[docs.columns[i] for i in keep], "n_tokens", "ids")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    vocabulary = _vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(vocabulary.value)
        for batch in batches:
            texts = [tables.decode(np.asarray(x.values)) if x.is_valid else "" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded whole text.

    Null counts as empty: no ids, and the digests of nothing. Repeated rows repeat; an empty table
    gives an empty table.
    """
    vocabulary = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(vocabulary.value)
        for batch in batches:
            n, shas, decoded = [], [], []
            for text in batch.column("text"):
                ids = tables.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                shas.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(tables.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return pick(docs, "doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
