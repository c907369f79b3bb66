"""Second-order boosted trees on binned features, many models side by side.

Each model (a problem) has its own rows of one frame. Feature values become bins between
approximate quantiles, stored once as bytes. A tree grows level by level: sums of first and
second derivatives by (node, feature, bin), then the best cut of every node.

Problems whose binned rows are counted to fit a task are grouped into one task each and
grown there whole. The rows of larger ones stay where they are: each level is one job for all
large problems together, in which tasks send one row of sums for each node and feature;
their margins are written anew every few rounds. Both ways share every function, and
derivatives are rounded to a grid on which sums are exact, so both grow the same trees.

Rows of a problem with the same bins always have the same margin. In problems of many rows
whose trees see them all, such rows are summed to one row with a weight before any tree grows,
so the work follows the different bins, not the rows.

Features must hold no NaN (preprocessing fills gaps); rows with a NULL label are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.session import settle

BINS = 256                # a bin is one byte
TASK_CELLS = 64_000_000   # rows times features of a problem that one task may hold
MERGE_ROWS = 200_000      # rows of a problem beyond which rows of the same bins become one
SETTLE_EVERY = 20         # rounds after which distributed margins are written
_GRID = 2.0 ** -24        # derivatives are multiples of this share of their range


@dataclass(frozen=True)
class Growth:
    """Settings of all trees of a fit."""

    rounds: int = 300
    depth: int = 5
    rate: float = 0.05
    rows: float = 1.0           # share of the rows that a tree sees
    columns: float = 1.0        # share of the features that a tree may cut
    penalty: float = 1.0        # added to the sum of second derivatives
    least_hessian: float = 1.0  # of a child
    seed: int = 42


@dataclass
class Trees:
    """Complete trees in heap order: feature -1 marks a leaf; rows with a value above the cut go right."""

    feature: np.ndarray     # rounds x nodes
    cut: np.ndarray         # as the bin of the last value that goes left
    value: np.ndarray
    base: float

    def between(self, start: int, until: int) -> Trees:
        return Trees(self.feature[start:until], self.cut[start:until], self.value[start:until], self.base)

    @staticmethod
    def empty(growth: Growth, base: float) -> Trees:
        shape = (growth.rounds, 2 ** (growth.depth + 1) - 1)
        return Trees(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape), base)


@dataclass
class Problem:
    """What all tasks need to know of a problem besides its rows."""

    kind: str               # "classification" or "regression"
    cuts: list[np.ndarray]  # of each feature
    rows: int
    base: float
    scale: float            # bound of the first derivatives, a power of two
    merged: bool = False    # rows are sums over rows of the same bins, their labels in steps from the origin

    @property
    def origin(self) -> float:
        return 0.0 if self.kind == "classification" else self.base

    def in_steps(self, values: np.ndarray) -> np.ndarray:
        """Whole numbers, so that their sums are exact."""
        return np.round((values - self.origin) / (self.scale * _GRID))


def _bins_of(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, values[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _derivatives(problem: Problem, label: np.ndarray, margin: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if problem.kind == "classification":
        value = 1.0 / (1.0 + np.exp(-margin))
        h = np.maximum(value * (1 - value), 1e-16)
    else:
        value, h = margin, np.ones(len(label))
    step = problem.scale * _GRID
    g = weight * problem.in_steps(value) - label if problem.merged else np.round((value - label) / step)
    return g * step, weight * (np.round(h / _GRID) * _GRID)


def _seen(uid: np.ndarray, tree: int, growth: Growth) -> np.ndarray:
    """Which rows a tree sees: a hash of seed, tree and row, alike in every task."""
    if growth.rows >= 1:
        return np.ones(len(uid), dtype=bool)
    x = uid.astype(np.uint64) + np.uint64((growth.seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x < np.uint64(int(growth.rows * 2 ** 64))


def _columns(features: int, tree: int, growth: Growth) -> np.ndarray:
    if growth.columns >= 1:
        return np.arange(features)
    rng = np.random.default_rng([growth.seed, tree])
    return np.sort(rng.choice(features, max(1, round(features * growth.columns)), replace=False))


def _nodes(trees: Trees, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
    """Heap number of the node of each row after so many levels; rows in leaves stay there."""
    node = np.zeros(len(bins), dtype=np.int64)
    for _ in range(levels):
        node = _step(trees, tree, bins, node)
    return node


def _step(trees: Trees, tree: int, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The same one level further down."""
    f = trees.feature[tree][node]
    right = bins[np.arange(len(bins)), np.maximum(f, 0)] > trees.cut[tree][node]
    return np.where(f >= 0, 2 * node + 1 + right, node)


def _sums(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, columns: np.ndarray) -> np.ndarray:
    """[2, nodes of the level, columns, bins] of summed derivatives."""
    first, n = 2 ** level - 1, 2 ** level
    if level and not (open_ := node >= first).all():
        bins, node, g, h = bins[open_], node[open_], g[open_], h[open_]
    start, out = (node - first) * BINS, np.empty((2, n, len(columns), BINS))
    for i, column in enumerate(columns):
        cell = start + bins[:, column]
        for x, total in zip((g, h), out):
            total[:, i] = np.bincount(cell, x, n * BINS).reshape(n, BINS)
    return out


def _best_cut(sums: np.ndarray, growth: Growth) -> tuple[np.ndarray, ...]:
    """For [2, ..., bins]: gain, bin, and the sums left and in all; gain is -inf where no cut is allowed."""
    left = np.cumsum(sums, axis=-1)
    total = left[..., -1:]
    right = total - left
    part = lambda x: x[0] ** 2 / (x[1] + growth.penalty)
    gain = (part(left) + part(right) - part(total)) / 2
    gain = np.where((left[1] >= growth.least_hessian) & (right[1] >= growth.least_hessian), gain, -np.inf)
    best = np.argmax(gain, axis=-1)
    take = lambda x: np.take_along_axis(x, best[..., None], -1)[..., 0]
    return take(gain), best, take(left[0]), take(left[1]), total[0][..., 0], total[1][..., 0]


def _set_node(trees: Trees, tree: int, node: int, growth: Growth, feature: int, cut: int, left: tuple, total: tuple) -> None:
    """Cut a node; its children become leaves until they are cut themselves."""
    leaf = lambda g, h: -growth.rate * g / (h + growth.penalty)
    trees.feature[tree, node], trees.cut[tree, node] = feature, cut
    trees.value[tree, 2 * node + 1] = leaf(*left)
    trees.value[tree, 2 * node + 2] = leaf(total[0] - left[0], total[1] - left[1])


def _grow_here(problem: Problem, growth: Growth, uid: np.ndarray, bins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Trees:
    """All trees of a problem whose rows are at hand."""
    trees = Trees.empty(growth, problem.base)
    margin = np.full(len(label), problem.base)
    bins = np.asfortranarray(bins)      # read by columns
    for tree in range(growth.rounds):
        b, (sg, sh), columns = bins, _derivatives(problem, label, margin, weight), _columns(bins.shape[1], tree, growth)
        if growth.rows < 1:
            seen = _seen(uid, tree, growth)
            b, sg, sh = bins[seen], sg[seen], sh[seen]
        trees.value[tree, 0] = -growth.rate * sg.sum() / (sh.sum() + growth.penalty)
        node = np.zeros(len(b), dtype=np.int64)
        for level in range(growth.depth):
            found = _best_cut(_sums(b, node, sg, sh, level, columns), growth)
            any_cut = False
            for i in range(2 ** level):
                f = int(np.argmax(found[0][i]))
                if found[0][i, f] > 0:
                    _set_node(trees, tree, 2 ** level - 1 + i, growth, int(columns[f]), int(found[1][i, f]),
                              (found[2][i, f], found[3][i, f]), (found[4][i, f], found[5][i, f]))
                    any_cut = True
            if not any_cut:
                break
            node = _step(trees, tree, b, node)
        margin += trees.value[tree][node if growth.rows >= 1 else _nodes(trees, tree, bins, growth.depth)]
    return trees


def _stacked(column) -> np.ndarray:
    rows = [np.frombuffer(b, dtype=np.uint8) for b in column]
    return np.stack(rows) if rows else np.zeros((0, 0), np.uint8)


def _by_problem(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict]]:
    for batch in batches:
        rows = batch.to_pandas()
        for name, part in rows.groupby("problem", sort=True):
            yield name, {"uid": part["uid"].to_numpy(), "bins": _stacked(part["bins"]), "label": part["label"].to_numpy(),
                         "margin": part["margin"].to_numpy(), "weight": part["weight"].to_numpy()}


def _grow_apart(binned: DataFrame, problems: dict[str, Problem], growth: Growth) -> dict[str, Trees]:
    """All trees of problems whose rows stay in their partitions: one job for each level, for all problems."""
    grown = {name: Trees.empty(growth, p.base) for name, p in problems.items()}
    state, settled = binned, 0
    for tree in range(growth.rounds):
        if tree and tree % SETTLE_EVERY == 0:
            recent = {n: t.between(settled, tree) for n, t in grown.items()}
            state, settled = settle(_with_margins(state, recent, growth), "margins"), tree
        open_ = dict(problems)
        for level in range(growth.depth):
            # Tasks get the trees since the margins were written, and the one that grows.
            recent = {n: grown[n].between(settled, tree + 1) for n in open_}
            for r in _level(state, open_, recent, tree, level, growth):
                trees, node = grown[r["problem"]], 2 ** level - 1 + r["node"]
                if level == 0:
                    trees.value[tree, 0] = -growth.rate * r["total_g"] / (r["total_h"] + growth.penalty)
                if r["gain"] > 0:
                    _set_node(trees, tree, node, growth, r["feature"], r["cut"], (r["left_g"], r["left_h"]), (r["total_g"], r["total_h"]))
            open_ = {n: p for n, p in open_.items() if (grown[n].feature[tree, 2 ** level - 1:2 ** (level + 1) - 1] >= 0).any()}
            if not open_:
                break
    return grown


def _margin(rows: dict, trees: Trees, until: int, growth: Growth) -> np.ndarray:
    margin = rows["margin"].copy()
    for tree in range(until):
        margin += trees.value[tree][_nodes(trees, tree, rows["bins"], growth.depth)]
    return margin


def _with_margins(state: DataFrame, recent: dict[str, Trees], growth: Growth) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, rows in _by_problem([batch]):
                margin = _margin(rows, recent[name], len(recent[name].feature), growth)
                yield pa.RecordBatch.from_pydict({"problem": [name] * len(margin), "uid": rows["uid"], "bins": [b.tobytes() for b in rows["bins"]],
                                                  "label": rows["label"], "margin": margin, "weight": rows["weight"]})

    return state.mapInArrow(run, state.schema)


def _level(state: DataFrame, problems: dict[str, Problem], recent: dict[str, Trees], tree: int, level: int, growth: Growth) -> list:
    """The best cut of every node of a level of the last of the recent trees: one row for each problem and node."""
    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for name, rows in _by_problem(batches):
            if name not in problems:
                continue
            last = len(recent[name].feature) - 1
            margin = _margin(rows, recent[name], last, growth)
            g, h = _derivatives(problems[name], rows["label"], margin, rows["weight"])
            seen, columns = _seen(rows["uid"], tree, growth), _columns(rows["bins"].shape[1], tree, growth)
            bins = rows["bins"][seen]
            found = _sums(bins, _nodes(recent[name], last, bins, level), g[seen], h[seen], level, columns)
            total[name] = total[name] + found if name in total else found
        for name, found in total.items():
            columns = _columns(len(problems[name].cuts), tree, growth)
            met = np.argwhere(found[1].any(axis=-1))
            yield pa.RecordBatch.from_pydict({
                "problem": pa.array([name] * len(met)), "node": pa.array(met[:, 0].astype(np.int32)),
                "feature": pa.array(columns[met[:, 1]].astype(np.int32)),
                "sums": pa.array([found[:, i, f].tobytes() for i, f in met], pa.binary())})

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        summed = sum(np.frombuffer(b).reshape(2, BINS) for b in rows["sums"])
        gain, cut, left_g, left_h, total_g, total_h = (float(x) for x in _best_cut(summed, growth))
        return pd.DataFrame([(rows["problem"].iloc[0], rows["node"].iloc[0], rows["feature"].iloc[0], max(gain, -1.0), int(cut), left_g, left_h,
                              total_g, total_h)], columns=["problem", "node", "feature", "gain", "cut", "left_g", "left_h", "total_g", "total_h"])

    parts = state.mapInArrow(sums, "problem string, node int, feature int, sums binary")
    found = parts.groupBy("problem", "node", "feature").applyInPandas(
        best, "problem string, node int, feature int, gain double, cut int, left_g double, left_h double, total_g double, total_h double")
    # Of equal gains the first feature's, as argmax takes it.
    first = F.max_by(F.struct(*found.columns), F.struct("gain", -F.col("feature")))
    return [r["r"] for r in found.groupBy("problem", "node").agg(first.alias("r")).collect()]


def _describe(rows: DataFrame, kinds: dict[str, str]) -> dict[str, Problem]:
    """Cuts, sizes and starting values of every problem, by three aggregations."""
    shares = F.lit([i / BINS for i in range(1, BINS)])
    values = rows.select("problem", F.posexplode("x").alias("feature", "value"))
    cuts: dict[str, dict[int, np.ndarray]] = {}
    for r in values.groupBy("problem", "feature").agg(F.percentile_approx("value", shares, 10_000).alias("cuts")).collect():
        cuts.setdefault(r["problem"], {})[r["feature"]] = np.unique(np.array(r["cuts"]))
    out = {}
    for r in rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean"), F.min("label").alias("low"),
                                         F.max("label").alias("high")).collect():
        name, kind, found = r["problem"], kinds[r["problem"]], cuts.get(r["problem"], {})
        if kind == "classification":
            p = min(max(r["mean"], 1e-6), 1 - 1e-6)
            base, scale = float(np.log(p / (1 - p))), 1.0
        else:
            base = float(r["mean"])
            scale = 2.0 ** np.ceil(np.log2(max(r["high"] - base, base - r["low"], 1e-300)))
        out[name] = Problem(kind, [found[f] for f in range(len(found))], r["n"], base, float(scale))
    return out


def grow(df: DataFrame, kinds: dict[str, str], growth: Growth, features: str = "features", task_cells: int = TASK_CELLS,
         merge_rows: int = MERGE_ROWS) -> dict[str, BoostedTrees]:
    """Fit all problems of a frame (problem string, features vector, label double): problem -> fitted trees."""
    rows = settle(df.where("label is not null").select(
        F.col("problem").cast("string").alias("problem"), F.monotonically_increasing_id().alias("uid"), vector_to_array(features).alias("x"),
        F.col("label").cast("double").alias("label")), "boosting-rows")
    problems = _describe(rows, kinds)
    for problem in problems.values():
        problem.merged = growth.rows >= 1 and problem.rows > merge_rows

    def to_bins(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for name, part in frame.groupby("problem", sort=True):
                problem, label = problems[name], part["label"].to_numpy()
                bins = _bins_of(np.stack(part["x"].to_numpy()), problem.cuts)
                yield pa.RecordBatch.from_pydict({
                    "problem": part["problem"].tolist(), "uid": part["uid"].to_numpy(), "bins": [b.tobytes() for b in bins],
                    "label": problem.in_steps(label) if problem.merged else label, "margin": np.full(len(part), problem.base), "weight": np.ones(len(part))})

    def binned_of(names: list[str]) -> DataFrame:
        return rows.where(F.col("problem").isin(names)).mapInArrow(
            to_bins, "problem string, uid long, bins binary, label double, margin double, weight double")

    many = [n for n, p in problems.items() if p.merged]
    binned = binned_of([n for n in problems if n not in many])
    if many:
        summed = binned_of(many).groupBy("problem", "bins").agg(
            F.min("uid").alias("uid"), F.sum("label").alias("label"), F.first("margin").alias("margin"), F.sum("weight").alias("weight"))
        binned = binned.unionByName(summed)
    binned = settle(binned, "bins")
    sizes = {r["problem"]: r["count"] for r in binned.groupBy("problem").count().collect()}
    small = {n: p for n, p in problems.items() if sizes[n] * len(p.cuts) <= task_cells}
    large = {n: p for n, p in problems.items() if n not in small}

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid")
        name = part["problem"].iloc[0]
        trees = _grow_here(small[name], growth, part["uid"].to_numpy(), _stacked(part["bins"]), part["label"].to_numpy(),
                           part["weight"].to_numpy())
        return pd.DataFrame([(name, trees.feature.tobytes(), trees.cut.tobytes(), trees.value.tobytes())], columns=["problem", "feature", "cut", "value"])

    grown: dict[str, Trees] = {}
    if small:
        # More partitions than problems, so that few share one and most are grown side by side.
        mine = binned.where(F.col("problem").isin(list(small))).repartition(10 * len(small) if len(small) > 1 else 1, "problem")
        shape = (growth.rounds, 2 ** (growth.depth + 1) - 1)
        for r in mine.groupBy("problem").applyInPandas(whole, "problem string, feature binary, cut binary, value binary").collect():
            grown[r["problem"]] = Trees(np.frombuffer(r["feature"], np.int32).reshape(shape), np.frombuffer(r["cut"], np.int32).reshape(shape),
                                        np.frombuffer(r["value"]).reshape(shape), small[r["problem"]].base)
    if large:
        grown |= _grow_apart(settle(binned.where(F.col("problem").isin(list(large))), "bins"), large, growth)
    return {name: BoostedTrees.of(problems[name], trees, features) for name, trees in grown.items()}


class BoostedTrees(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `prediction`, for a classification also `probability` (of the classes 0 and 1)."""

    kind = Param(Params._dummy(), "kind", "classification or regression", TypeConverters.toString)
    nodes = Param(Params._dummy(), "nodes", "nodes of a tree", TypeConverters.toInt)
    base = Param(Params._dummy(), "base", "margin without trees", TypeConverters.toFloat)
    feature = Param(Params._dummy(), "feature", "cut feature of each node, -1 in a leaf", TypeConverters.toListInt)
    threshold = Param(Params._dummy(), "threshold", "largest value that goes left", TypeConverters.toListFloat)
    value = Param(Params._dummy(), "value", "of each node as a leaf", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, kind=None, nodes=None, base=None, feature=None, threshold=None, value=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(problem: Problem, trees: Trees, features: str) -> BoostedTrees:
        flat_f, flat_c = trees.feature.ravel(), trees.cut.ravel()
        threshold = [float(problem.cuts[f][min(c, len(problem.cuts[f]) - 1)]) if f >= 0 else 0.0 for f, c in zip(flat_f.tolist(), flat_c.tolist())]
        return BoostedTrees(inputCol=features, kind=problem.kind, nodes=int(trees.feature.shape[1]), base=problem.base, feature=flat_f.tolist(),
                            threshold=threshold, value=trees.value.ravel().tolist())

    def margins(self, x: np.ndarray) -> np.ndarray:
        nodes = self.getOrDefault(self.nodes)
        feature, threshold, value = (np.array(self.getOrDefault(p)).reshape(-1, nodes) for p in (self.feature, self.threshold, self.value))
        out, at = np.full(len(x), self.getOrDefault(self.base)), np.arange(len(x))
        depth = (nodes + 1).bit_length() - 2
        for f, cut, v in zip(feature, threshold, value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                right = x[at, np.maximum(f[node], 0)] > cut[node]
                node = np.where(f[node] >= 0, 2 * node + 1 + right, node)
            out += v[node]
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf(T.DoubleType())
        def margin(rows: pd.Series) -> pd.Series:
            return pd.Series(model.margins(np.stack(rows.to_numpy())) if len(rows) else [], dtype=float)

        scored = dataset.withColumn("margin", margin(vector_to_array(self.getInputCol())))
        if self.getOrDefault(self.kind) == "regression":
            return scored.withColumn("prediction", F.col("margin")).drop("margin")
        p = 1 / (1 + F.exp(-F.col("margin")))
        return (scored.withColumn("probability", array_to_vector(F.array(1 - p, p)))
                .withColumn("prediction", (F.col("margin") > 0).cast("double")).drop("margin"))
