"""Random forests over rows that fit one task: whole trees on exact cuts, blocks of trees in tasks.

Every task gets all rows and grows its own block of trees (Breiman 2001): a bootstrap of the
rows, at each node a choice of sqrt(features), Gini impurity, down to pure leaves or the given
depth. If no chosen feature varies in a node, the others are looked at. A tree depends on the
seed, its number and the rows, whatever their order and the block.

A forest of few rows is a model in memory. Trees over more rows have as many nodes in all as
rows times trees, so they stay in files: tasks write them, and rows to be scored meet one block
of trees at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.session import settle

MODEL_ROWS = 4096           # rows of a forest that is a model in memory
TASK_CELLS = 16_000_000     # rows times features that a task may hold
BLOCK = 50                  # trees of a task
STORED_BLOCK = 10           # the same where trees stay in files
TILE_ROWS = 20_000          # rows that meet a block of stored trees in a task
_SCORED_ROWS = 1024         # rows that walk through all trees at once


def best_cut(x: np.ndarray, weight: np.ndarray, ones: np.ndarray) -> tuple[int, float] | None:
    """(column, value) of the cut with the least impurity; None if no column varies."""
    order = np.argsort(x, axis=0, kind="stable")
    values = np.take_along_axis(x, order, axis=0)
    left, left_ones = np.cumsum(weight[order], axis=0), np.cumsum(ones[order], axis=0)
    right, right_ones = left[-1] - left[:-1], left_ones[-1] - left_ones[:-1]
    left, left_ones = left[:-1], left_ones[:-1]
    impure = left_ones * (left - left_ones) / left + right_ones * (right - right_ones) / right
    impure[values[:-1] == values[1:]] = np.inf
    at, column = np.unravel_index(int(np.argmin(impure)), impure.shape)
    if not np.isfinite(impure[at, column]):
        return None
    low, high = values[at, column], values[at + 1, column]
    middle = low / 2 + high / 2
    return int(column), float(middle if low <= middle < high else low)


def grow_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> pd.DataFrame:
    """One tree as rows (feature, cut, child, value): -1 marks a leaf, the right child follows the left one."""
    n, columns = x.shape
    weight = np.bincount(rng.integers(0, n, n), minlength=n).astype(float)
    ones = weight * y
    few = max(1, int(np.sqrt(columns)))
    feature, cut, child, value = [-1], [0.0], [-1], [0.0]
    waiting = [(0, np.flatnonzero(weight), depth)]
    while waiting:
        node, rows, levels = waiting.pop()
        total, positive = weight[rows].sum(), ones[rows].sum()
        value[node] = positive / total
        if levels == 0 or positive in (0.0, total):
            continue
        mixed = rng.permutation(columns)
        for asked in (mixed[:few], mixed[few:]):
            found = best_cut(x[np.ix_(rows, asked)], weight[rows], ones[rows]) if len(asked) else None
            if found:
                feature[node], cut[node], child[node] = int(asked[found[0]]), found[1], len(feature)
                goes = x[rows, feature[node]] > cut[node]
                for k, part in enumerate((rows[~goes], rows[goes])):
                    waiting.append((child[node] + k, part, levels - 1))
                for column, empty in ((feature, -1), (cut, 0.0), (child, -1), (value, 0.0)):
                    column.extend([empty, empty])
                break
    return pd.DataFrame({"feature": feature, "cut": cut, "child": child, "value": value})


class Forest(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `probability` (mean share of the leaves) and `prediction`."""

    starts = Param(Params._dummy(), "starts", "first node of each tree", TypeConverters.toListInt)
    feature = Param(Params._dummy(), "feature", "cut feature of each node, -1 in a leaf", TypeConverters.toListInt)
    cut = Param(Params._dummy(), "cut", "largest value that goes left", TypeConverters.toListFloat)
    child = Param(Params._dummy(), "child", "left child; the right one follows", TypeConverters.toListInt)
    value = Param(Params._dummy(), "value", "share of class 1", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, starts=None, feature=None, cut=None, child=None, value=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(trees: pd.DataFrame, features: str) -> Forest:
        """Rows (tree, node, feature, cut, child, value), nodes of a tree numbered from 0."""
        trees = trees.sort_values(["tree", "node"], ignore_index=True)
        starts = np.flatnonzero(trees["node"].to_numpy() == 0)
        sizes = np.diff(np.append(starts, len(trees)))
        child = np.where(trees["child"] < 0, -1, trees["child"] + np.repeat(starts, sizes))
        return Forest(inputCol=features, starts=starts.tolist(), feature=trees["feature"].tolist(), cut=trees["cut"].tolist(),
                      child=child.tolist(), value=trees["value"].tolist())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        starts, feature, cut, child, value = (np.array(self.getOrDefault(p)) for p in (
            self.starts, self.feature, self.cut, self.child, self.value))

        def shares(x: np.ndarray) -> np.ndarray:
            node, rows = np.tile(starts, (len(x), 1)), np.arange(len(x))[:, None]
            while (inner := feature[node] >= 0).any():
                right = x[rows, np.maximum(feature[node], 0)] > cut[node]
                node = np.where(inner, child[node] + right, node)
            return value[node].mean(axis=1)

        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            parts = [shares(np.stack(rows.iloc[i:i + _SCORED_ROWS].to_numpy())) for i in range(0, len(rows), _SCORED_ROWS)]
            return pd.Series(np.concatenate(parts) if parts else [], dtype=float)

        scored = dataset.withColumn("share", score(vector_to_array(self.getInputCol())))
        return (scored.withColumn("probability", array_to_vector(F.array(1 - F.col("share"), F.col("share"))))
                .withColumn("prediction", (F.col("share") > 0.5).cast("double")).drop("share"))


def _grow_blocks(rows: pd.DataFrame, trees: int, depth: int, seed: int, size: int):
    """The trees of a block over all rows."""
    x, y = np.stack(rows["x"].to_numpy()), rows["label"].to_numpy()
    order = np.lexsort([y, *x.T[::-1]])
    x, y = x[order], y[order]
    first = int(rows["block"].iloc[0]) * size
    for t in range(first, min(first + size, trees)):
        yield t, grow_tree(x, y, np.random.default_rng([seed, t]), depth)


def _rows_of_blocks(df: DataFrame, features: str, trees: int, size: int) -> DataFrame:
    blocks = F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // size))).alias("block")
    return df.select(vector_to_array(features).alias("x"), F.col("label").cast("double").alias("label"), blocks)


def fit_in_tasks(df: DataFrame, features: str, trees: int, depth: int, seed: int) -> Forest:
    """A forest of the frame, which is counted to have at most MODEL_ROWS rows."""
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        grown = [tree.assign(tree=t) for t, tree in _grow_blocks(rows, trees, depth, seed, BLOCK)]
        return pd.concat(grown).rename_axis("node").reset_index()

    rows = _rows_of_blocks(df, features, trees, BLOCK)
    schema = "tree long, node long, feature long, cut double, child long, value double"
    return Forest.of(rows.groupBy("block").applyInPandas(grow, schema).toPandas(), features)


class _StoredWriter(DefaultParamsWriter):
    """Saves the trees beside the parameters."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.trees().write.parquet(f"{path}/trees")


class _StoredReader(DefaultParamsReader):
    def load(self, path: str) -> StoredForest:
        return super().load(path)._set(path=f"{path}/trees")


class StoredForest(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """As Forest, for trees in files: the frame is kept in the shared folder and joined with its shares."""

    path = Param(Params._dummy(), "path", "folder of the trees: block, tree and the columns of its nodes as bytes", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, path=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def write(self) -> DefaultParamsWriter:
        return _StoredWriter(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _StoredReader(cls)

    def trees(self) -> DataFrame:
        return SparkSession.getActiveSession().read.parquet(self.getOrDefault(self.path))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def shares(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(trees):
                return pd.DataFrame({"row": [], "from": [], "total": []})
            x, at = np.stack(rows["x"].to_numpy()), np.arange(len(rows))
            total = np.zeros(len(rows))
            for tree in trees.sort_values("tree").itertuples():
                feature, cut, child, value = (np.frombuffer(b, t) for b, t in zip(
                    (tree.feature, tree.cut, tree.child, tree.value), _KINDS))
                node = np.zeros(len(rows), np.int64)
                while (inner := feature[node] >= 0).any():
                    node = np.where(inner, child[node] + (x[at, np.maximum(feature[node], 0)] > cut[node]), node)
                total += value[node]
            return pd.DataFrame({"row": rows["row"], "from": trees["block"].iloc[0], "total": total})

        trees = self.trees()
        size = trees.agg(F.max("block").alias("last"), F.count(F.lit(1)).alias("n")).first()
        kept = settle(dataset.withColumn("__row", F.monotonically_increasing_id()), "to-score")
        tiles = max(1, -(-kept.count() // TILE_ROWS))
        left = kept.select(F.col("__row").alias("row"), vector_to_array(self.getInputCol()).alias("x"),
                           F.pmod(F.xxhash64("__row"), F.lit(tiles)).alias("tile"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size["last"]).cast("long"))).alias("block"))
        right = trees.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
        found = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInPandas(
            shares, "row long, from long, total double")
        # Summed in the order of the blocks, so that reruns agree to the last digit.
        summed = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("from", "total"))).alias("parts")).select(
            F.col("row").alias("__scored"), (F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["total"]) / size["n"]).alias("share"))
        scored = kept.join(summed, F.col("__row") == F.col("__scored"))
        return (scored.withColumn("probability", array_to_vector(F.array(1 - F.col("share"), F.col("share"))))
                .withColumn("prediction", (F.col("share") > 0.5).cast("double")).drop("share", "__row", "__scored"))


_KINDS = (np.int32, np.float64, np.int32, np.float64)


def fit_stored(df: DataFrame, features: str, trees: int, depth: int, seed: int) -> StoredForest:
    """A forest of the frame, which is counted to have at most TASK_CELLS rows times features; no tree passes the driver."""
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        made = [(block, t, *(tree[c].to_numpy(k).tobytes() for c, k in zip(("feature", "cut", "child", "value"), _KINDS)))
                for t, tree in _grow_blocks(rows, trees, depth, seed, STORED_BLOCK)]
        return pd.DataFrame(made, columns=["block", "tree", "feature", "cut", "child", "value"])

    rows = _rows_of_blocks(df, features, trees, STORED_BLOCK).repartition(4 * ((trees - 1) // STORED_BLOCK + 1), "block")
    grown = rows.groupBy("block").applyInPandas(grow, "block long, tree long, feature binary, cut binary, child binary, value binary")
    return StoredForest(inputCol=features, path=settle(grown, "trees").settled_path)
