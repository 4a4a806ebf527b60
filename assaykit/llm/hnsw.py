"""Nearest neighbours by inner product: a navigable small-world graph per shard, results merged.

Equal vectors are collapsed, and the distinct ones are dealt to shards of a bounded size by hash. The
graph of a shard has levels, each with a sixteenth of the nodes below it; a node is linked to
diverse near neighbours on each of its levels. It is stored as flat arrays in one row. Queries go to
every shard in bounded groups, are searched in lockstep, and the shards' results are merged.

Vectors are scaled by the longest of their shard and get one more component that makes all lengths
equal, so that the largest inner product is the nearest point on the sphere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import pick
from assaykit.session import broadcast_if_small, materialize

SHARD = 8_192  # distinct vectors in a shard
QUERIES = 1_024  # queries searched against a shard at a time
LINKS, LINKS_0 = 16, 32  # of a node on an upper level, and on the lowest
CANDIDATES = 64  # neighbours that links are chosen from
BEAM = 160  # width of the search on the lowest level
STEP = 4  # nodes expanded at once
_BLOCK = 256


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of each row, nearest first, and their nearness."""
    k = min(k, len(x) - 1)
    ids, near = np.empty((len(x), k), np.int32), np.empty((len(x), k), np.float32)
    for a in range(0, len(x), _BLOCK):
        s = x[a : a + _BLOCK] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(s), 0), np.int64)
        value = np.take_along_axis(s, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        ids[a : a + _BLOCK], near[a : a + _BLOCK] = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    return ids, near


def _diverse(x: np.ndarray, ids: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """Which candidates to link: those nearer to the node than to a candidate linked before, ``links`` at most."""
    chosen = np.zeros(ids.shape, bool)
    for a in range(0, len(x), _BLOCK):
        c = x[ids[a : a + _BLOCK]]
        between = np.matmul(c, c.transpose(0, 2, 1))
        take = chosen[a : a + _BLOCK]
        closest = np.full(take.shape, -np.inf, np.float32)
        for j in range(ids.shape[1]):
            take[:, j] = (near[a : a + _BLOCK, j] > closest[:, j]) & (take.sum(axis=1) < links)
            closest = np.where(take[:, j : j + 1], np.maximum(closest, between[:, j]), closest)
    return chosen


def _level(x: np.ndarray, links: int) -> np.ndarray:
    """Neighbours of each row, -1 where there are fewer: chosen ones, those that chose it, then the nearest."""
    if len(x) < 2:
        return np.full((len(x), links), -1, np.int32)
    ids, near = _nearest(x, CANDIDATES)
    chosen = _diverse(x, ids, near, links // 2)
    n, k = ids.shape
    a, b, s = np.repeat(np.arange(n), k), ids.ravel().astype(np.int64), near.ravel()
    own = chosen.ravel()
    src, dst = np.concatenate([a[own], b[own], a]), np.concatenate([b[own], a[own], b])
    kind = np.concatenate([np.zeros(own.sum(), int), np.ones(own.sum(), int), np.full(len(a), 2)])
    order = np.lexsort((-np.concatenate([s[own], s[own], s]), kind, src))
    src, dst = src[order], dst[order]
    _, first = np.unique(src * n + dst, return_index=True)
    first.sort()
    src, dst = src[first], dst[first]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    out = np.full((n, links), -1, np.int32)
    keep = place < links
    out[src[keep], place[keep]] = dst[keep]
    return _joined(x, out)


def _joined(x: np.ndarray, links: np.ndarray) -> np.ndarray:
    """``links`` with a way from row 0 to every row: what is out of reach is linked from its nearest reached row."""
    extra: list[tuple[int, int]] = []
    reached = np.zeros(len(x), bool)
    front = np.array([0])
    while True:
        while len(front):
            reached[front] = True
            after = np.unique(links[front])
            front = after[(after >= 0)]
            front = front[~reached[front]]
        if reached.all():
            break
        lost = np.flatnonzero(~reached)[:_BLOCK]
        s = np.where(reached, x[lost] @ x.T, -np.inf)
        i = int(np.argmax(s.max(axis=1)))
        extra.append((int(np.argmax(s[i])), int(lost[i])))
        front = lost[i : i + 1]
    if extra:
        width = int(np.bincount([a for a, _ in extra]).max())
        links = np.concatenate([links, np.full((len(x), width), -1, np.int32)], axis=1)
        for a, b in extra:
            links[a, np.flatnonzero(links[a] < 0)[-1]] = b
    return links


def build(vectors: np.ndarray, draws: np.ndarray) -> dict[str, np.ndarray]:
    """Flat arrays of a graph over ``vectors``; ``draws`` are uniform 32-bit numbers that set the levels."""
    length = np.sqrt((vectors**2).sum(axis=1))
    longest = length.max()
    rest = np.sqrt(np.maximum(0, 1 - (length / longest) ** 2))
    x = np.concatenate([vectors / longest, rest[:, None]], axis=1).astype(np.float32)
    height = np.minimum(np.floor(-np.log((draws + 1.0) / 2**32) / np.log(LINKS)), 8).astype(int)
    order = np.lexsort((draws, -height))  # nodes of a level are the first ones
    x, height = x[order], height[order]
    out = {"order": order.astype(np.int32), "points": x.ravel(), "sizes": [], "widths": [], "links": []}
    for level in range(height[0] + 1):
        n = int((height >= level).sum())
        links = _level(x[:n], LINKS if level else LINKS_0)
        out["sizes"].append(n)
        out["widths"].append(links.shape[1])
        out["links"].append(links.ravel())
    return out | {"sizes": np.array(out["sizes"], np.int32), "widths": np.array(out["widths"], np.int32), "links": np.concatenate(out["links"]).astype(np.int32)}


def _walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Beam search on one level for all queries at once: the ``width`` best nodes found, -1 where fewer."""
    n_q, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n_q, len(x) + 1), bool)
    seen[:, -1] = True
    beam = np.full((n_q, width), -1, np.int64)
    near = np.full((n_q, width), -np.inf, np.float32)
    fresh = np.zeros((n_q, width), bool)
    m = min(width, start.shape[1])
    beam[:, :m], near[:, :m] = start[:, :m], np.einsum("qd,qmd->qm", q, x[start[:, :m]])
    near[:, :m][start[:, :m] < 0] = -np.inf
    fresh[:, :m] = start[:, :m] >= 0
    seen[rows, start] = True
    step = min(STEP, width)
    active = np.arange(n_q)
    while len(active):
        value = np.where(fresh[active], near[active], -np.inf)
        top = np.argpartition(-value, step - 1, axis=1)[:, :step]
        good = np.take_along_axis(value, top, 1) > -np.inf
        going = good.any(axis=1)
        active, top, good = active[going], top[going], good[going]
        if not len(active):
            break
        at = active[:, None]
        fresh[at, top] = False
        nodes = np.where(good, beam[at, top], -1)
        found = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1).astype(np.int64)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[seen[at, found]] = -1
        seen[at, found] = True
        value = np.einsum("qd,qmd->qm", q[active], x[found])
        value[found < 0] = -np.inf
        all_ids = np.concatenate([beam[active], found], axis=1)
        all_near = np.concatenate([near[active], value], axis=1)
        all_fresh = np.concatenate([fresh[active], found >= 0], axis=1)
        best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        beam[active], near[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_near, best, 1)
        fresh[active] = np.take_along_axis(all_fresh, best, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.where(np.take_along_axis(near, order, 1) > -np.inf, np.take_along_axis(beam, order, 1), -1)


def search(graph: dict[str, np.ndarray], queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Row numbers of the vectors found near each query, -1 where there are fewer than ``beam``."""
    n = len(graph["order"])
    x = graph["points"].reshape(n, -1)
    q = queries / np.sqrt((queries**2).sum(axis=1))[:, None]
    q = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
    ends = np.cumsum(graph["sizes"] * graph["widths"])
    at = np.zeros((len(q), 1), np.int64)
    for level in range(len(graph["sizes"]) - 1, -1, -1):
        size, width = int(graph["sizes"][level]), int(graph["widths"][level])
        links = graph["links"][ends[level] - size * width : ends[level]].reshape(size, width)
        at = _walk(x[:size], links, q, at, 8 if level else min(beam, n))
    return np.where(at >= 0, graph["order"][at], -1)


_ARRAYS = {"order": np.int32, "points": np.float32, "sizes": np.int32, "widths": np.int32, "links": np.int32}
_GRAPH = "dim int, shard bigint, n int, vectors binary, ids binary, n_ids binary, " + ", ".join(f"{c} binary" for c in _ARRAYS)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _build_shard(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("mark")
    vectors, draws = _matrix(rows.column("v")), (rows.column("mark").to_numpy() >> 16) & 0xFFFFFFFF
    graph = build(vectors, draws)
    ids = rows.column("ids").combine_chunks()
    data = {"dim": [rows.column("dim")[0].as_py()], "shard": [rows.column("shard")[0].as_py()], "n": [rows.num_rows]}
    data |= {"vectors": [vectors.tobytes()], "ids": [ids.flatten().to_numpy().astype(np.int64).tobytes()], "n_ids": [np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes()]}
    data |= {c: [graph[c].tobytes()] for c in _ARRAYS}
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("vectors", "ids", "n_ids", *_ARRAYS)]])
    return pa.table(data, schema=schema)


def index(vectors: DataFrame, copies: int) -> DataFrame:
    """One row per shard with its graph as flat arrays, from (vec_id, v); ``copies`` ids are kept of equal vectors."""
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = vectors.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= copies)
    distinct = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = materialize(distinct.select("v", "ids", F.size("v").alias("dim"), F.xxhash64("v").alias("mark")), "vectors")
    sizes = distinct.groupBy("dim").agg(F.expr(f"count(*) div {SHARD} + 1").alias("n_shards"))
    dealt = distinct.join(broadcast_if_small(sizes), "dim").withColumn("shard", F.pmod("mark", "n_shards")).drop("n_shards")
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(_build_shard, _GRAPH), "graphs")


def _search_shard(k: int):
    def run(shard: pa.Table, group: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not shard.num_rows or not group.num_rows:
            return schema.empty_table()
        row = {c: shard.column(c)[0].as_py() for c in shard.column_names}
        graph = {c: np.frombuffer(row[c], kind) for c, kind in _ARRAYS.items()}
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], -1)
        n_ids = np.frombuffer(row["n_ids"], np.int32)
        ids, ends = np.frombuffer(row["ids"], np.int64), np.cumsum(n_ids)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        query_ids, queries = group.column("query_id").to_numpy(), _matrix(group.column("q"))
        for a in range(0, len(queries), _BLOCK):
            q = queries[a : a + _BLOCK]
            found = search(graph, q)
            score = np.zeros(found.shape)
            for d in range(q.shape[1]):  # one order of summation, whatever the shape
                score += q[:, d : d + 1] * vectors[found, d]
            score[found < 0] = -np.inf
            for query, some, values in zip(query_ids[a : a + _BLOCK], found, score):
                # nodes as good as the last that can be needed stay until the ids have decided
                least = np.partition(values, -k - 1)[-k - 1] if len(values) > k else -np.inf
                held = (some >= 0) & (values >= least)
                some, values = some[held], values[held]
                vec = np.concatenate([ids[ends[i] - n_ids[i] : ends[i]] for i in some])
                values = np.repeat(values, n_ids[some])
                other = vec != query
                vec, values = vec[other], values[other]
                best = np.lexsort((vec, -values))[:k]
                out.append((np.full(len(best), query), vec[best], values[best]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

    return run


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among ``embeddings``.

    Both tables hold (vec_id, embedding). Nearness is the inner product in double precision, ties go
    to the smaller vec_id, and rows with the query's vec_id are no candidates. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part, nor do null ids; a vector meets
    those of its own length only. Repeated rows count once. With no vectors or queries the result is
    empty.
    """
    graphs = index(_usable(embeddings), k + 1)
    asked = _usable(queries).distinct().select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim"))
    asked = asked.withColumn("mark", F.xxhash64("query_id", "q"))
    per_dim = asked.groupBy("dim").agg(F.expr(f"count(*) div {QUERIES} + 1").alias("n_groups"))
    shards = graphs.select("dim", "shard")
    # each group of queries meets each shard of its dimension: both are bounded blocks
    sized = broadcast_if_small(per_dim)
    dealt = asked.join(sized, "dim").withColumn("part", F.pmod("mark", "n_groups")).drop("n_groups", "mark").join(broadcast_if_small(shards), "dim")
    copies = graphs.join(sized, "dim").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_groups") - 1))).drop("n_groups")
    keys = ["dim", "shard", "part"]
    dealt = dealt.select("query_id", "q", *[F.col(c).alias(c) for c in keys])  # columns of its own, apart from the shards'
    found = copies.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_search_shard(k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _usable(embeddings: DataFrame) -> DataFrame:
    rows = pick(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))


def stated_queries(embeddings: DataFrame, every: int = 20) -> DataFrame:
    """The rows whose vec_id is divisible by ``every``."""
    return pick(embeddings, "vec_id", "embedding").where(F.col("vec_id") % every == 0)
