"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from assaykit.llm import lexical
from assaykit.llm.lexical import nra, ranked_search

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id bigint, text string, item_id string, Text int", "item_id bigint, text string, doc_id int, Text string"


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(UPPER))


def brute(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in counted:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def search(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(5)
    return sorted((tuple(r) for r in ranked_search(d, spark.createDataFrame([(i, t, 1, "y") for i, t in items], ITEMS), **more).collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éA", "W1", "x_y", "don't", "9.5"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(words[int(len(words) * rng.random() ** 2)] for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(300)]
    docs += [(i, "w1 w2 w3") for i in range(400, 440)] + [(7, docs[3][1]), (None, docs[4][1]), (None, "w1 w2 w3"), (500, None), (501, ""), (502, " .-_ ")]
    docs += [(503, "w1 " * 5000 + text(3000))]
    items = [(i, text(rng.randrange(1, 25))) for i in range(20)] + [(3, "w1 w2"), (3, "w1 w2"), (30, None), (31, "..."), (32, "unheard of"), (None, "w5 w5 W5")]
    return docs, items


@pytest.mark.parametrize("per_shard, per_block", [(10_000, 50_000), (37, 40)])
def test_against_brute_force(spark, tables, monkeypatch, per_shard, per_block):
    monkeypatch.setattr(lexical, "DOCS_PER_SHARD", per_shard)
    monkeypatch.setattr(lexical, "TERMS_PER_BLOCK", per_block)
    monkeypatch.setattr(lexical, "_FIRST_READ", 2)
    monkeypatch.setattr(lexical, "_TOKENISED_BYTES", 64)
    docs, items = tables
    assert search(spark, docs, items) == brute(docs, items)
    assert search(spark, docs, items[:5], k=3) == brute(docs, items[:5], 3)


def test_empty(spark, tables):
    docs, items = tables
    assert search(spark, [], items) == search(spark, docs, []) == search(spark, [(1, None)], items) == []


def test_reads_no_further_than_needed(monkeypatch):
    """A document that leads every list settles the search after the first reads."""
    monkeypatch.setattr(lexical, "_FIRST_READ", 4)
    size, reads = 10_000, Counter()

    class Watched(np.ndarray):
        def __getitem__(self, key):
            reads[id(self)] += key.stop - key.start if isinstance(key, slice) else 0
            return np.asarray(super().__getitem__(key))

    docs = np.arange(size)
    impact = np.concatenate(([10**6], np.linspace(500, 1, size - 1).astype(np.int64)))
    lists = [(docs.view(Watched), impact) for _ in range(3)]
    best, score = nra(lists, size, 1, docs)
    assert best.tolist() == [0] and score.tolist() == [3 * 10**6]
    assert max(reads.values()) < 100


def test_random_lists():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size, k = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        full = rng.integers(0, 4, (int(rng.integers(1, 6)), size)) * (rng.random((1, size)) < 0.7)
        lists = []
        for row in full:
            d = np.flatnonzero(row)
            if len(d):
                d = d[np.argsort(-row[d], kind="stable")]
                lists.append((d, row[d]))
        place = rng.permutation(size)
        if lists:
            total = full.sum(axis=0)
            want = sorted((d for d in range(size) if total[d]), key=lambda d: (-total[d], place[d]))[:k]
            best, score = nra(lists, size, k, place)
            assert best.tolist() == want and score.tolist() == total[want].tolist()
