"""Boosted trees with second-order gains, an L2 (and L1) penalty on leaves, and best-first growth.

Feature values become bins once. A tree grows in a few passes: every pass gives each row its open leaf,
sums gradients and hessians per (leaf, feature, bin) on the way to one exchange, and finds the best split
of each leaf by running sums over the bins, all as DataFrame operations; the driver sees one row per open
leaf. Leaves are split in the order of their gain until the tree has as many as it may have. Margins are
written now and then, so that a pass never replays more than a few trees.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.session import discard, materialize

# Rows, drawn by hash, that the borders of bins are taken from; all rows are binned and counted.
BORDER_ROWS = 20_000
# Trees that a pass replays at most before the margins are written.
TREES_KEPT = 10
MOST_BINS = 255


@dataclass(frozen=True)
class BoostingSettings:
    """``leaves`` None grows by depth alone; ``depth`` None by leaves alone."""

    trees: int = 100
    rate: float = 0.1
    leaves: int | None = 31
    depth: int | None = None
    l2: float = 0.0
    l1: float = 0.0
    min_gain: float = 0.0
    min_hessian: float = 1e-3
    min_rows: int = 1
    row_share: float = 1.0
    column_share: float = 1.0
    # standard deviation of the noise on gains, as a share of the largest gain of a pass
    noise: float = 0.0
    bins: int = MOST_BINS
    seed: int = 42

    def __post_init__(self):
        if not self.leaves and not self.depth:
            raise ValueError("give a number of leaves or a depth")
        if self.trees < 1 or not 2 <= self.bins <= MOST_BINS or self.l2 < 0 or self.l1 < 0:
            raise ValueError("trees from 1, bins from 2 to 255, penalties from 0")
        if not 0 < self.row_share <= 1 or not 0 < self.column_share <= 1:
            raise ValueError("shares are above 0 and up to 1")


@dataclass
class Tree:
    """Nodes by number: the root is 0. A leaf has feature -1; a value up to the border goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    border: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, border: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.border[node], self.left[node], self.right[node] = feature, border, at, at + 1
        for _ in range(2):
            self.feature.append(-1)
            self.border.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(0.0)
        return at, at + 1


class _Rows:
    """Rows of a batch in sparse form, looked up by feature; ``default`` is the value of what is not there."""

    def __init__(self, batch: pa.RecordBatch, default: np.ndarray):
        indices, values = batch.column("indices"), batch.column("values")
        index = indices.flatten().to_numpy()
        order = np.argsort(index, kind="stable")
        self.n, self.default = batch.num_rows, default
        self.feature, self.values = index[order], values.flatten().to_numpy()[order]
        self.row = np.repeat(np.arange(self.n), indices.value_lengths().to_numpy())[order]

    def column(self, feature: int) -> np.ndarray:
        a, b = np.searchsorted(self.feature, [feature, feature + 1])
        out = np.full(self.n, self.default[feature], self.values.dtype)
        out[self.row[a:b]] = self.values[a:b]
        return out

    def leaf(self, tree: Tree) -> np.ndarray:
        """The node of ``tree`` that each row ends in."""
        at = np.zeros(self.n, np.int64)
        for node, feature in enumerate(tree.feature):  # parents come before their children
            if feature >= 0:
                here = np.flatnonzero(at == node)
                if len(here):
                    goes_left = self.column(feature)[here] <= tree.border[node]
                    at[here] = np.where(goes_left, tree.left[node], tree.right[node])
        return at

    def margin(self, trees: list[Tree]) -> np.ndarray:
        out = np.zeros(self.n)
        for tree in trees:
            out += np.array(tree.value)[self.leaf(tree)]
        return out


def _sparse(features: str) -> tuple[Column, Column]:
    """Indices and values of the non-zero features, in order."""
    pairs = F.filter(F.transform(vector_to_array(features), lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: p["v"] != 0)
    return F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["v"]).alias("values")


def _borders(rows: DataFrame, n_rows: int, n_features: int, bins: int) -> list[np.ndarray]:
    """Ascending borders between bins for each feature, from a bounded hash sample of the rows."""
    share = min(1.0, BORDER_ROWS / max(n_rows, 1))
    sample = rows.where(F.pmod("mark", F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("indices", "values").limit(2 * BORDER_ROWS)
    index, value, n = [], [], 0
    for i, v in sample.toLocalIterator():
        index += i
        value += v
        n += 1
    index, value = np.array(index, np.int64), np.array(value, float)
    order = np.lexsort((value, index))
    index, value = index[order], value[order]
    out = []
    for a, b in zip(*(np.searchsorted(index, np.arange(n_features), side) for side in ("left", "right"))):
        held = value[a:b]
        if b - a < n:  # the others are zero
            held = np.sort(np.append(held, np.zeros(n - (b - a))))
        different = np.unique(held)
        if len(different) > bins:
            different = np.unique(held[(np.arange(bins) * len(held)) // bins])
        out.append((different[1:] + different[:-1]) / 2)
    return out


def _binned(rows: DataFrame, borders: list[np.ndarray], default: np.ndarray) -> DataFrame:
    """Values become bins; entries in the bin of zero and features without borders are left out."""
    flat = np.concatenate([np.zeros(0), *borders])
    begin = np.concatenate([[0], np.cumsum([len(b) for b in borders])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            indices, values = batch.column("indices"), batch.column("values")
            index, value, sizes = indices.flatten().to_numpy(), values.flatten().to_numpy(), indices.value_lengths().to_numpy()
            bins = np.zeros(len(index), np.int32)
            order = np.argsort(index, kind="stable")
            cuts = np.flatnonzero(np.diff(index[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                f = index[part[0]]
                bins[part] = np.searchsorted(flat[begin[f] : begin[f + 1]], value[part], "left")
            keep = bins != default[index]
            row = np.repeat(np.arange(len(sizes)), sizes)[keep]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]), pa.int32())
            columns = [batch.column(c) for c in ("y", "w", "mark", "margin")]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[keep], pa.int32())) for x in (index, bins)]
            yield pa.RecordBatch.from_arrays([*columns, *lists], ["y", "w", "mark", "margin", "indices", "values"])

    return rows.select("y", "w", "mark", "margin", "indices", "values").mapInArrow(
        run, "y double, w double, mark long, margin double, indices array<int>, values array<int>"
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers; the same everywhere."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _histograms(rows: DataFrame, done: list[Tree], tree: Tree, nodes: list[int], default: np.ndarray, used: np.ndarray, turn: int, s: BoostingSettings) -> DataFrame:
    """(node, feature, bin, default, g, h, n) of the rows in ``nodes``, added up by task; nodes by their place in the list.

    With features all unused there is a row for each node, of feature -1, with its sums.
    """
    wanted = np.full(len(tree.feature), -1)
    wanted[nodes] = np.arange(len(nodes))
    width, top = len(default) + 1, int(max([s.bins, *default])) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros((3, 0))
        for batch in batches:
            data = _Rows(batch, default)
            y, w, margin = (batch.column(c).to_numpy() for c in ("y", "w", "margin"))
            p = 1 / (1 + np.exp(-(margin + data.margin(done))))
            each = np.stack([w * (p - y), w * p * (1 - p), np.ones(len(y))])
            node = wanted[data.leaf(tree)]
            if s.row_share < 1:
                mark = batch.column("mark").to_numpy().view(np.uint64) + np.uint64((1 + turn) * 0x9E3779B97F4A7C15 % 2**64)
                node[_mixed(mark) >= np.uint64(int(s.row_share * (2**64 - 1)))] = -1
            if used.any():
                keep = np.flatnonzero((node[data.row] >= 0) & used[data.feature])
                row = data.row[keep]
                key = (node[row] * width + data.feature[keep] + 1) * top + data.values[keep]
            else:
                row = np.flatnonzero(node >= 0)
                key = node[row] * width * top
            keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
            more = np.concatenate([sums, each[:, row]], axis=1)
            sums = np.stack([np.bincount(at, m, len(keys)) for m in more])
        feature = keys // top % width - 1
        numbers = [keys // top // width, feature, keys % top, np.where(feature >= 0, default[feature], 0)]
        columns = [*[pa.array(x, pa.int32()) for x in numbers], pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "feature", "bin", "default", "g", "h", "n"])

    return rows.mapInArrow(run, "node int, feature int, bin int, default int, g double, h double, n long")


def _best_splits(parts: DataFrame, totals: list[tuple[float, float, int]], turn: int, s: BoostingSettings) -> dict[int, dict]:
    """The best split of each node that has one: feature, last bin of the left side, gain, and the sums of the left.

    One exchange, by node and feature; the running sums over the bins follow in place.
    """
    whole = {c: F.get(F.split(F.lit(",".join(repr(float(t[i])) for t in totals)), ",").cast("array<double>"), F.col("node")) for i, c in enumerate("ghn")}
    sums = parts.repartition("node", "feature").groupBy("node", "feature", "bin", "default").agg(*[F.sum(c).alias(c) for c in "ghn"])
    group = Window.partitionBy("node", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.select("*", *[F.sum(c).over(upto).alias(f"{c}_upto") for c in "ghn"], *[F.sum(c).over(group).alias(f"{c}_all") for c in "ghn"], F.lag("bin").over(group.orderBy("bin")).alias("before"))
    # what is not listed of a feature is in the bin of zero, which is also a place to split at
    rest = {c: whole[c] - F.col(f"{c}_all") for c in "ghn"}
    own = F.struct(F.col("bin").alias("bin"), *[(F.col(f"{c}_upto") + F.when(F.col("default") < F.col("bin"), rest[c]).otherwise(0)).alias(c) for c in "ghn"])
    zero = F.struct(F.col("default").alias("bin"), *[(F.col(f"{c}_upto") - F.col(c) + rest[c]).alias(c) for c in "ghn"])
    is_next = (F.col("default") < F.col("bin")) & (F.coalesce("before", F.lit(-1)) < F.col("default"))
    sides = run.select("node", "feature", F.explode(F.when(is_next, F.array(own, zero)).otherwise(F.array(own))).alias("e")).select("node", "feature", "e.*")

    def score(g: Column, h: Column) -> Column:
        shrunk = F.greatest(F.abs(g) - s.l1, F.lit(0.0))
        return F.when(h + s.l2 > 0, shrunk * shrunk / (h + s.l2)).otherwise(0.0)

    g, h, n = (F.col(c) for c in "ghn")
    gain = score(g, h) + score(whole["g"] - g, whole["h"] - h) - score(whole["g"], whole["h"])
    rows = F.lit(max(s.min_rows, 1))
    allowed = (n >= rows) & (whole["n"] - n >= rows) & (h >= s.min_hessian) & (whole["h"] - h >= s.min_hessian)
    found = sides.where(allowed).withColumn("gain", gain).where(F.col("gain") > s.min_gain + 1e-12)
    order = F.col("gain")
    if s.noise:
        uniform = lambda i: (F.pmod(F.xxhash64(F.lit(s.seed), F.lit(turn), F.lit(i), "node", "feature", "bin"), F.lit(1 << 40)) + 1) / float(1 << 40)
        normal = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))
        order = order + s.noise * normal * F.max("gain").over(Window.partitionBy("node"))
    best = found.withColumn("o", order).groupBy("node").agg(
        F.max_by(F.struct("feature", "bin", "gain", "g", "h", "n"), F.struct("o", -F.col("feature"), -F.col("bin"))).alias("b")
    )
    return {r["node"]: r["b"].asDict() for r in best.collect()}  # one row per open node


def _grown(rows: DataFrame, done: list[Tree], default: np.ndarray, turn: int, s: BoostingSettings) -> Tree:
    """One tree: borders are numbers of bins, values are not scaled yet.

    Every pass evaluates the nodes that best-first growth needs to know by then. It ends when all
    children of the nodes that are split have been evaluated, so that the order is the true one.
    """
    rng = np.random.default_rng([s.seed, turn])
    used = np.ones(len(default), bool)
    if s.column_share < 1:
        used[rng.permutation(len(default))[max(1, round(s.column_share * len(default))) :]] = False
    full, depth, unknown = Tree(), {0: 0}, [0]
    root = _histograms(rows, done, full, [0], default, np.zeros(len(default), bool), turn, s).agg(F.sum("g"), F.sum("h"), F.sum("n")).first()
    sums = {0: tuple(x or 0 for x in root)}
    known: dict[int, dict | None] = {}
    while unknown:
        best = _best_splits(_histograms(rows, done, full, unknown, default, used, turn, s), [sums[node] for node in unknown], turn, s)
        known |= {node: best.get(i) for i, node in enumerate(unknown)}
        queue, chosen, unknown = [(-math.inf, 0)], [], []
        while queue and len(chosen) + 1 < (s.leaves or 1 << 30):
            _, node = heapq.heappop(queue)
            split = known[node]
            if split is None:
                continue
            if full.feature[node] < 0:
                children = full.split(node, split["feature"], split["bin"])
                depth |= {child: depth[node] + 1 for child in children}
                left = tuple(split[c] for c in "ghn")
                sums |= zip(children, (left, tuple(a - b for a, b in zip(sums[node], left))))
            chosen.append(node)
            for child in (full.left[node], full.right[node]):
                if s.depth and depth[child] >= s.depth:
                    continue
                if child not in known:
                    unknown.append(child)
                elif known[child]:
                    heapq.heappush(queue, (-known[child]["gain"], child))
    return _pruned(full, set(chosen), sums, s)


def _pruned(full: Tree, chosen: set[int], sums: dict[int, tuple], s: BoostingSettings) -> Tree:
    """The part of ``full`` that is split at the chosen nodes, with the value of each leaf."""
    out, stack = Tree(), [(0, 0)]
    while stack:
        node, at = stack.pop()
        if node in chosen:
            left, right = out.split(at, full.feature[node], full.border[node])
            stack += [(full.left[node], left), (full.right[node], right)]
        else:
            g, h, _ = sums[node]
            shrunk = math.copysign(max(abs(g) - s.l1, 0.0), g)
            out.value[at] = -s.rate * shrunk / (h + s.l2) if h + s.l2 > 0 else 0.0
    return out


class HistogramBoosting(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Binary classifier over a vector column, with a label of 0 and 1 and a weight column.

    A table without rows raises ValueError. With one class only, every tree is a single leaf near zero.
    """

    settings = Param(Params._dummy(), "settings", "BoostingSettings as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, settings=None, featuresCol="features", labelCol="label", weightCol=None):
        super().__init__()
        self._setDefault(settings=json.dumps(asdict(BoostingSettings())), featuresCol="features", labelCol="label")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> BoostedModel:
        s = BoostingSettings(**json.loads(self.getOrDefault(self.settings)))
        features, label = self.getOrDefault(self.featuresCol), F.col(self.getOrDefault(self.labelCol)).cast("double")
        weight = F.col(self.getOrDefault(self.weightCol)).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        indices, values = _sparse(features)
        raw = df.select(label.alias("y"), weight.alias("w"), F.size(vector_to_array(features)).alias("size"), indices, values)
        raw = materialize(raw.withColumns({"mark": F.xxhash64(F.lit(s.seed), "indices", "values", F.monotonically_increasing_id()), "margin": F.lit(0.0)}), "rows")
        n, n_features, positive, total = raw.agg(F.count("*"), F.max("size"), F.sum(F.col("y") * F.col("w")), F.sum("w")).first()
        if not n:
            raise ValueError("no rows to fit on")
        share = min(max(positive / total, 1e-12), 1 - 1e-12)
        base = math.log(share / (1 - share))
        borders = _borders(raw, n, n_features, s.bins)
        default = np.array([np.searchsorted(b, 0.0, "left") for b in borders], np.int64)
        rows = materialize(_binned(raw.withColumn("margin", F.lit(base)), borders, default), "binned")
        discard(raw)
        trees, recent = [], []
        for turn in range(s.trees):
            recent.append(_grown(rows, recent, default, turn, s))
            if len(recent) == TREES_KEPT and turn + 1 < s.trees:
                moved = materialize(_moved(rows, recent, default), "margins")
                discard(rows)
                rows, trees, recent = moved, trees + recent, []
        discard(rows)
        told = []
        for tree in trees + recent:
            at = [float(borders[f][int(b)]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.border)]
            told.append(asdict(Tree(tree.feature, at, tree.left, tree.right, tree.value)))
        return BoostedModel(featuresCol=features, trees=json.dumps({"base": base, "features": n_features, "trees": told}))


def _moved(rows: DataFrame, trees: list[Tree], default: np.ndarray) -> DataFrame:
    """``rows`` with the margins after ``trees``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("margin")
            yield batch.set_column(at, "margin", pa.array(batch.column(at).to_numpy() + _Rows(batch, default).margin(trees)))

    return rows.mapInArrow(run, rows.schema)


class BoostedModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds rawPrediction, probability (vectors) and prediction (0.0 or 1.0)."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "base score and trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", trees=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def fitted(self) -> tuple[float, list[Tree]]:
        told = json.loads(self.getOrDefault(self.trees))
        return told["base"], [Tree(**t) for t in told["trees"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        base, trees = self.fitted()
        default = np.zeros(json.loads(self.getOrDefault(self.trees))["features"])
        sent = df.sparkSession.sparkContext.broadcast((trees, default))

        @F.arrow_udf("double")
        def margin(indices: pa.Array, values: pa.Array) -> pa.Array:
            batch = pa.RecordBatch.from_arrays([indices, values], ["indices", "values"])
            return pa.array(base + _Rows(batch, sent.value[1]).margin(sent.value[0]))

        raw = margin(*_sparse(self.getOrDefault(self.featuresCol)))
        held = df.withColumn("__margin", raw)
        p = 1 / (1 + F.exp(-F.col("__margin")))
        out = {"rawPrediction": array_to_vector(F.array(-F.col("__margin"), F.col("__margin"))), "probability": array_to_vector(F.array(1 - p, p))}
        return held.withColumns(out | {"prediction": (F.col("__margin") > 0).cast("double")}).drop("__margin")
