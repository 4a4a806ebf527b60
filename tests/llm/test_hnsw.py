"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from assaykit.llm import hnsw
from assaykit.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, Vec_ID string"


def brute(rows, queries, k):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and ok(v)})
    out = {}
    for q, v in sorted({(i, tuple(v)) for i, v in queries if i is not None and ok(v)}):
        scored = []
        for i, w in rows:
            if i != q and len(w) == len(v):
                score = 0.0
                for a, b in zip(v, w):
                    score += a * b
                scored.append((-score, i))
        best = {}
        for s, i in sorted(scored):
            best.setdefault(i, s)
        out[q] = [(i, -s) for i, s in sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]]
    return out


def result(spark, rows, queries, k):
    a, b = (spark.createDataFrame([(i, v, "x") for i, v in t], SCHEMA) for t in (rows, queries))
    out = {}
    for r in sorted(hnsw.nearest(a, b, k).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def f32(x):
    return [float(np.float32(v)) for v in x]


def test_small_tables_are_exact(spark, monkeypatch):
    """While a shard has no more nodes than the beam, everything reached is kept."""
    monkeypatch.setattr(hnsw, "SHARD", 40)
    rng = np.random.default_rng(1)
    rows = [(int(i), f32(rng.normal(size=8) * rng.choice([0.1, 1, 30]))) for i in rng.permutation(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [rows[1], rows[1]]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] + [1.0] * 7), (2004, [None] + [1.0] * 7), (2005, [float("inf")] * 8), (None, rows[0][1]), (2006, [1.0, 2.0]), (2020, [3.0, 2.0])]
    queries = rows[:20] + [rows[201], (2004, rows[-5][1]), (2020, [3.0, 2.0]), (5000, f32(rng.normal(size=8)))]
    assert result(spark, rows, queries, 20) == brute(rows, queries, 20)
    assert result(spark, rows[:1], rows[:1], 5) == {}
    assert result(spark, [], rows[:3], 5) == {} and result(spark, rows, [], 5) == {}


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_recall_of_one_graph(kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64))
    if kind == "clusters":
        x = x[rng.integers(0, 40, 6000)] + 0.05 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = hnsw.search(hnsw.build(x, rng.integers(0, 2**32, 6000)), x[:300])
    want = np.argsort(-(x[:300] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, want)]) > 0.93


def test_whole_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {}
    for r in QUERIES["op6_hnsw_search"](spark, small).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / len(want[q]) for q in want]) > 0.95
    for q in want:
        assert all(got[q][i] == s for i, s in want[q] if i in got[q])


def test_equal_scores_go_by_the_smaller_id(spark):
    """400 different vectors with one inner product: all that were found are ordered by id before the cut."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, float(x), float(y)]) for i, (x, y) in enumerate(rng.standard_normal((400, 2)))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    query = spark.createDataFrame([(1000, [1.0, 0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = hnsw.nearest(table, query, 20).orderBy("rank").collect()
    ids = [r.vec_id for r in got]
    assert len(got) == 20 and {r.score for r in got} == {1.0} and ids == sorted(ids)
    wider = [r.vec_id for r in hnsw.nearest(table, query, 40).orderBy("rank").collect()]
    assert wider[:20] == ids
