"""MinHash near dedup against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from assaykit.llm import near_dedup
from assaykit.llm.near_dedup import near_groups, sketch
from assaykit.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(sets):
        if d is None:
            continue
        for j in {j for x in s for j in by[x] if j < i}:
            e, t = sets[j]
            common = len(s & t)
            if e is not None and 100 * common >= percent * (len(s) + len(t) - common):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    out = []
    for d, s in sets:
        c = d if d is None or not s else root(d)
        out.append((d, len(s), c, c == d))
    return sorted(out, key=repr)


def result(spark, rows, k=3, percent=85):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id bigint, text string, component_id int")
    return sorted([tuple(r) for r in near_groups(df, k, percent).collect()], key=repr)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for size in (1, 1, 2, 3, 60, 25):
        base = rng.choices(words, k=rng.choice([8, 40, 200]) if size < 20 else 150)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 18))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((at := at + rng.randrange(1, 5), " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    rows += [(at + i, rows[3][1]) for i in range(1, 6)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_planted_groups(spark, planted, k, percent, monkeypatch):
    assert result(spark, planted, k, percent) == brute(planted, k, percent)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a b c d"), (None, "a b c d"), (9, "a b c d"), (8, "A b C d"), (8, "A b C d")]
    rows += [(5, "x y"), (6, "X  y"), (4, "x"), (7, "long " * 30_000), (10, "long " * 20_000)]
    assert result(spark, rows) == brute(rows, 3, 85)
    assert result(spark, []) == []


def test_repeated_ids_bridge_their_groups(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (5, "p q r s"), (4, "p q r s"), (6, "u v w")]
    assert [r[2] for r in result(spark, rows)] == [3, 3, 3, 3, 6]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for n, common in ((1, 1), (5, 4), (300, 200), (3000, 2700)):
        x = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
        a, b = sketch([np.sort(x[:n]), np.sort(x[n - common :])], 2000)
        assert abs((a == b).mean() - common / (2 * n - common)) < 0.05
        assert (a != np.iinfo(np.uint64).max).all()


def test_small_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in QUERIES["op9_minhash_near_dedup"](spark, small).collect()], key=repr) == brute(rows, 3, 85)


def test_sets_differ_in_at_least_as_many_shingles_as_parity_bits():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 4000, n).astype(np.uint64)) for n in (0, 1, 40, 300, 320, 3000)]
    sets.append(np.union1d(sets[3][20:], sets[2]))
    bits = near_dedup.parity(sets)
    assert not bits[0].any()
    for a, x in zip(sets, bits):
        for b, y in zip(sets, bits):
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
