"""Substring dedup against brute force."""

import hashlib
import random
import re

import pytest

from assaykit.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows, window):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, Text string")
    return sorted([tuple(r) for r in substring_dedup(df, window).collect()], key=repr)


@pytest.mark.parametrize("window", [6, 7, 50])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(window - 2, 3 * window))] for _ in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += [rng.choice(words) for _ in range(rng.randrange(0, 20))] + rng.choice(passages)
        rows.append((d * 3 % 61, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100 + i, rows[5][1]) for i in range(5)] + [(None, rows[7][1]), (7, None), (8, ""), (7, rows[9][1]), (7, rows[9][1])]
    rows += [(200, "same " * (3 * window)), (201, "same " * (2 * window)), (202, " x " * 9)]
    assert result(spark, rows, window) == brute(rows, window)


def test_empty(spark):
    assert result(spark, [], 50) == []


def test_small_table(spark, small):
    from assaykit.llm.queries import QUERIES

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted([tuple(r) for r in QUERIES["op10_substring_dedup"](spark, small).collect()], key=repr)
    assert got == brute([tuple(r) for r in docs], 50)
