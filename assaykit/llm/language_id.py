"""Language identification as a mixture of languages.

Each language is a distribution over hashed n-grams, counted over all labelled training rows. A
document's n-grams are drawn from a mixture of the languages; expectation-maximisation estimates the
shares. Its set of languages grows from the single best one: the language whose share would raise the
likelihood fastest is tried, and stays if the gain in likelihood is above the penalty of one more
parameter. The language with the largest share is the prediction, its share the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import pick
from assaykit.llm.wordhash import text_column

ORDER, CELL_BITS = 4, 16
CELLS = 1 << CELL_BITS
EM_STEPS = 20
SMOOTHING = 0.5
# The model is sent to every executor: 256 KB a language, 64 MB at most.
MOST_LANGUAGES = 256
UNKNOWN = "und"
_SLICE_VALUES = 1 << 22  # likelihoods held at once, a document at least

# Bytes of letters, A-Z as a-z; bytes from 0x80 on stay, everything else is a space.
_LETTER = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, count) of the n-grams of consecutive texts, ordered by text and cell.

    Runs of other characters than letters are one space; two spaces stand before a text and one behind.
    """
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size + 3)
    spaced = np.full(len(text), 32, np.uint8)
    pad = np.ones(len(text), bool)
    at = np.arange(len(data)) + 3 * np.repeat(np.arange(len(size)), size) + 2
    spaced[at], pad[at] = _LETTER[data], False
    blank = spaced == 32
    keep = pad | ~blank
    keep[1:] |= ~blank[:-1]
    ends = np.cumsum(size + 3) - 1
    keep[ends] = ~blank[ends - 1]  # one space at most behind the text
    spaced, text = spaced[keep].astype(np.uint32), text[keep]
    n = max(0, len(spaced) - ORDER + 1)
    value = np.zeros(n, np.uint32)
    for i in range(ORDER):
        value = (value << np.uint32(8)) | spaced[i : i + n]
    cell = (value * np.uint32(2654435761)) >> np.uint32(32 - CELL_BITS)
    inside = text[:n] == text[ORDER - 1 : ORDER - 1 + n]
    key, count = np.unique((text[:n][inside].astype(np.int64) << CELL_BITS) | cell[inside].astype(np.int64), return_counts=True)
    return key >> CELL_BITS, key & (CELLS - 1), count


def _texts(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) over consecutive rows of at most ``most`` bytes, a row at least."""
    texts = text_column(column)
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 0x20
    ascii_letters = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))))
    found = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
    return found


class LanguageModel:
    """Languages in ascending order, and the probability of each cell (rows) in each of them."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.p = ((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * CELLS)).astype(np.float32)

    def mixtures(self, text: np.ndarray, cell: np.ndarray, count: np.ndarray, n_texts: int) -> np.ndarray:
        """Shares of the languages (columns) in each text that has n-grams; they sum to 1."""
        shares = np.zeros((n_texts, len(self.languages)))
        has, first = np.unique(text, return_index=True)
        if not len(has):
            return shares
        shares[has] = _select(self.p[cell].astype(np.float64), count.astype(np.float64), first)
        return shares


def penalty(n: np.ndarray) -> np.ndarray:
    """Least gain in log-likelihood for one more language.

    Half the logarithm of the number of observations, as in the Bayesian information criterion; every
    letter stands in ORDER n-grams, so likelihoods count ORDER-fold.
    """
    return ORDER * 0.5 * np.log(np.maximum(n / ORDER, 1.0) + 1)


def _em(p: np.ndarray, count: np.ndarray, first: np.ndarray, row: np.ndarray, n: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares after EM_STEPS steps, and their log-likelihood; ``row`` is the text of each n-gram."""
    for _ in range(EM_STEPS):
        total = (p * shares[row]).sum(axis=1)
        shares = shares * np.add.reduceat(p * (count / total)[:, None], first) / n[:, None]
    return shares, np.add.reduceat(count * np.log((p * shares[row]).sum(axis=1)), first)


def _select(p: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares of the languages selected for each text; ``first`` is where its n-grams begin."""
    sizes = np.diff(np.append(first, len(p)))
    n = np.add.reduceat(count, first)
    each = np.add.reduceat(np.log(p) * count[:, None], first)
    sets = each.argmax(axis=1)[:, None]  # the languages chosen so far, and their shares
    shares, best = np.ones((len(first), 1)), each.max(axis=1)
    out = np.zeros_like(each)
    left = np.arange(len(first))  # texts still growing
    while len(left):
        row = np.repeat(np.arange(len(left)), sizes[left])
        at = np.repeat(first[left] - np.concatenate(([0], np.cumsum(sizes[left])[:-1])), sizes[left]) + np.arange(len(row))
        begin = np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
        own, c = p[at], count[at]
        chosen = own[np.arange(len(row))[:, None], sets[row]]
        # a language raises the likelihood if its mean ratio to the mixture is above 1
        gain = np.add.reduceat(own * (c / (chosen * shares[row]).sum(axis=1))[:, None], begin) / n[left][:, None]
        np.put_along_axis(gain, sets, -1, axis=1)
        more = gain.max(axis=1) > 1
        more_sets = np.concatenate((sets, gain.argmax(axis=1)[:, None]), axis=1)
        start = np.concatenate((0.9 * shares, np.full((len(left), 1), 0.1)), axis=1)
        tried = np.flatnonzero(more)
        grown, accepted = start[:0], np.zeros(len(left), bool)
        if len(tried):
            inner = more[row]
            row2 = np.repeat(np.arange(len(tried)), sizes[left[tried]])
            begin2 = np.concatenate(([0], np.cumsum(sizes[left[tried]])[:-1]))
            cols = own[inner][np.arange(len(row2))[:, None], more_sets[tried][row2]]
            grown, loglik = _em(cols, c[inner], begin2, row2, n[left[tried]], start[tried])
            better = loglik - best[left[tried]] > penalty(n[left[tried]])
            accepted[tried[better]] = True
            best[left[tried[better]]] = loglik[better]
            grown = grown[better]
        stay = ~accepted
        out[left[stay][:, None], sets[stay]] = shares[stay]
        left, sets, shares = left[accepted], more_sets[accepted], grown
        if len(left) and sets.shape[1] == p.shape[1]:
            out[left[:, None], sets] = shares
            break
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n): the n-grams of a task's rows, added up by language."""
    held: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            cell = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(counts[cell])], ["lang", "cell", "n"]
            )
        held.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, b, data, offsets in _texts(batch.column("text"), 1 << 20):
            text, cell, count = grams(data, offsets)
            for lang in set(langs[a:b]):
                mine = np.array([x == lang for x in langs[a:b]])[text]
                held.setdefault(lang, np.zeros(CELLS, np.int64))
                held[lang] += np.bincount(cell[mine], count[mine], CELLS).astype(np.int64)
        if len(held) > MOST_LANGUAGES:
            yield from rows()
    yield from rows()


def train(rows: DataFrame) -> LanguageModel:
    """The n-gram counts of all ``rows`` (text, lang) that have both; ValueError above MOST_LANGUAGES."""
    usable = pick(rows, "text", "lang").where("text is not null and lang is not null")
    cells = usable.mapInArrow(_counted, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    lists = cells.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # at most CELLS each
    lists = lists.select("lang", "cells.cell", "cells.n")
    languages, columns = [], []
    for lang, cell, n in lists.toLocalIterator():
        languages.append(lang)
        if len(languages) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        columns.append(np.bincount(np.array(cell, np.int64), np.array(n, np.float64), CELLS))
    order = sorted(range(len(languages)), key=languages.__getitem__)
    return LanguageModel([languages[i] for i in order], np.stack([columns[i] for i in order], axis=1) if order else np.zeros((CELLS, 0)))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without text, with lang_pred, score, and languages: the selected ones, largest share first.

    Only text is an input. A text that is null or has no letter is ``und`` with score 0 and no
    languages; so is every text if nothing was learned. Equal shares go by ascending language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        names = known.languages
        most = max(1 << 14, _SLICE_VALUES // max(1, 4 * len(names)))
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b, data, offsets in _texts(batch.column(at), most):
                shares = known.mixtures(*grams(data, offsets), b - a) if names else np.zeros((b - a, 1))
                shares[~_has_letter(data, offsets)] = 0
                found = shares.max(axis=1) > 0
                first = shares.argmax(axis=1)
                pred = [names[i] if f else UNKNOWN for i, f in zip(first.tolist(), found.tolist())]
                score = np.minimum(shares.max(axis=1), 1.0)
                listed = [[{"lang": names[j], "share": float(r[j])} for j in np.argsort(-r, kind="stable") if r[j] > 0] for r in shares]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(listed, kind)],
                    [*part.schema.names[:at], "lang_pred", "score", "languages"],
                )

    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {t}" for c, t in docs.select(*others).dtypes)
    return docs.select(*others, "text").mapInArrow(run, f"{schema}, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; not so for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score and languages.

    Learns from the rows that have an id and are not held out. Repeated rows repeat; an empty table
    gives an empty table; columns beside the three are not read. See ``predict`` for odd texts.
    """
    rows = pick(docs, "doc_id", "text", "lang").withColumn("held_out", is_held_out(F.col("doc_id")))
    model = train(rows.where("not held_out and doc_id is not null"))
    return predict(rows.select("doc_id", "held_out", "text"), model)
