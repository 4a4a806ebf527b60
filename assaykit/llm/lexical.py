"""Ranked lexical search by NRA (no random access) on impact-sorted lists.

One pass counts the query terms of every document. Documents are dealt over shards of a bounded size;
in its shard a term has a list of (document, impact), largest impact first. For each query the lists
are read in step from the front. What was read of a document is its lower bound, and what the lists in
which it was not met can still give is added for the upper bound. Reading goes on until no document,
met or not, can change the best k, their order among ties, or their scores. The best of all shards
are merged by a window that keeps k rows a partition before it shuffles.

Queries come in blocks of a bounded number of terms; each block is one pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import pick
from assaykit.session import materialize

# A term is a run of digits, ASCII letters and characters from U+0080 on.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS_PER_BLOCK = 50_000
DOCS_PER_SHARD, POSTINGS_PER_SHARD = 1 << 14, 1 << 21
_FIRST_READ = 64
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TOKENISED_BYTES = 1 << 20
_FOUND = "item_no bigint, doc_id bigint, score bigint"


def count_terms(text: str | None) -> Counter[bytes]:
    """Occurrences of each term of a whole text, a megabyte at a time."""
    raw, counts, at = (text or "").encode().translate(_TERM_BYTES), Counter(), 0
    while at < len(raw):
        to = raw.find(b" ", at + _TOKENISED_BYTES)
        counts.update(raw[at : to if to >= 0 else len(raw)].split())
        at = to if to >= 0 else len(raw)
    return counts


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, object, list[bytes]]]]:
    """(number, item_id, terms) of the items in blocks of at most TERMS_PER_BLOCK terms, an item at least."""
    block, size = [], 0
    for no, row in enumerate(pick(items, "item_id", "text").toLocalIterator()):
        terms = sorted(count_terms(row["text"]))
        if block and size + len(terms) > TERMS_PER_BLOCK:
            yield block
            block, size = [], 0
        block.append((no, row["item_id"], terms))
        size += len(terms)
    if block:
        yield block


def _profile(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length and its query terms."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, sizes, terms, tfs = [], [0], [], []
                for text in part.column("text"):
                    counts = count_terms(text.as_py())
                    n.append(counts.total())
                    found = [(known[t], tf) for t, tf in counts.items() if t in known]
                    terms += [t for t, _ in found]
                    tfs += [tf for _, tf in found]
                    sizes.append(len(terms))
                ends = pa.array(sizes, pa.int32())
                columns = [
                    part.column("doc_id"), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
                ]
                out = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(np.array(n) > 0))

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best k of ``size`` documents and their scores, out of lists of (documents, impacts > 0).

    Each list is read from the front only. Equal scores are ordered by ``place``.
    """
    lower = np.zeros(size, np.int64)
    seen = np.zeros((len(lists), size), bool)
    at = np.zeros(len(lists), np.int64)
    ends = np.array([len(d) for d, _ in lists], np.int64)
    bound = np.array([impact[0] for _, impact in lists], np.int64)
    active, step = range(len(lists)), _FIRST_READ
    while len(active):
        for i in active:
            docs, impact = lists[i]
            to = min(at[i] + step, ends[i])
            lower[docs[at[i] : to]] += impact[at[i] : to]
            seen[i, docs[at[i] : to]] = True
            at[i], bound[i] = to, impact[to - 1] if to < ends[i] else 0
        step *= 2
        rest = bound.sum()
        met = np.flatnonzero(lower)
        least = max(1, np.partition(lower[met], -k)[-k]) if len(met) >= k else 1
        met = met[lower[met] + rest >= least]
        missing = rest - bound @ seen[:, met]
        unsure = met[(lower[met] + missing >= least) & (missing > 0)]
        # a document that was not met yet has ``rest`` as its upper bound
        wanted = np.ones(len(lists), bool) if rest >= least else ~seen[:, unsure].all(axis=1)
        active = np.flatnonzero(wanted & (at < ends))
    met = np.flatnonzero(lower)
    if len(met) > k:
        met = met[lower[met] >= np.partition(lower[met], -k)[-k]]
    best = met[np.lexsort((place[met], -lower[met]))][:k]
    return best, lower[best]


def _shard_search(items: list[tuple[int, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """A function from the documents of a shard to each item's best k among them."""

    def run(shard: pa.Table) -> pa.Table:
        n = shard.column("n").to_numpy()
        terms, tfs = (shard.column(c).combine_chunks() for c in ("terms", "tfs"))
        doc = np.repeat(np.arange(len(n)), terms.value_lengths().to_numpy())
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        m = 10 + 90 * n * n_docs // n_terms
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        kept = np.flatnonzero(impact)
        kept = kept[np.lexsort((-impact[kept], term[kept]))]
        term, doc, impact = term[kept], doc[kept], impact[kept]
        edges = np.searchsorted(term, np.arange(len(weight) + 1))
        ids = shard.column("doc_id")
        place = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))).argsort()
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for no, wanted in items:
            lists = [(doc[edges[t] : edges[t + 1]], impact[edges[t] : edges[t + 1]]) for t in wanted.tolist() if edges[t] < edges[t + 1]]
            if lists:
                best, score = nra(lists, len(n), k, place)
                rows.append((np.full(len(best), no, np.int64), best, score))
        at, best, score = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        return pa.table({"item_no": at, "doc_id": ids.take(pa.array(best)), "score": score})

    return run


def _search_block(docs: DataFrame, block: list[tuple[int, object, list[bytes]]], k: int) -> DataFrame | None:
    number = {t: i for i, t in enumerate(sorted({t for _, _, terms in block for t in terms}))}
    profile = materialize(_profile(docs, number), "postings")
    n_docs, n_terms, n_postings = profile.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first()
    if not n_postings:
        return None
    df = np.zeros(len(number), np.int64)
    for t, held in profile.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[t] = held
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    wanted = [(no, np.array([number[t] for t in terms if df[number[t]] and weight[number[t]]], np.int64)) for no, _, terms in block]
    shards = max(math.ceil(n_docs / DOCS_PER_SHARD), math.ceil(n_postings / POSTINGS_PER_SHARD))
    dealt = profile.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(_shard_search(wanted, weight, n_docs, n_terms, k), _FOUND)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(no, item) for no, item, _ in block], "item_no bigint, item_id bigint")
    return materialize(best.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score"), "ranked")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Rows: item_id, rank from 1, doc_id, score. Every row of ``docs`` is a document, also one that
    repeats another or has no doc_id. Equal scores go by ascending doc_id, null last. Null and empty
    texts have no term: such a document is never found and counts nowhere, such an item has no rows. An
    item that stands twice has its rows twice. Empty tables give an empty table. Other columns are not
    read. All queries of a block are broadcast: at most TERMS_PER_BLOCK terms, or a single item.
    """
    found = [f for block in _blocks(items) if (f := _search_block(docs, block, k)) is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionAll, found)


RANKED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM benchmark),
s AS (SELECT count(*) AS c, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(c) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(terms) * c) // l AS m FROM d, s WHERE len(terms) > 0),
qt AS (SELECT DISTINCT q, item_id, t FROM (SELECT q, item_id, unnest(terms) AS t FROM i)),
x AS (SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM qt JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY q, r),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS "rank", doc_id, score FROM x WHERE score > 0)
SELECT item_id, "rank", doc_id, score FROM o WHERE "rank" <= 10"""
