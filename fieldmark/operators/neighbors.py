"""Exact k nearest neighbours without materialising pairs.

The reference rows are cut into blocks. A block that is proven small is sent to
every task; otherwise test tiles meet reference blocks in a cogroup, each pair
of tile and block in one bounded task. A task returns only the k best per test
row, and the best of the best are chosen after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 20_000
CELLS = 2_000_000     # distances a task holds at once: 16 MB of doubles, and a few arrays of that size
PAIRS = 50_000        # rows compared exactly at once


class _Block:
    """Train rows in memory, prepared once for all test rows that meet them."""

    def __init__(self, train: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.train, self.ids, self.labels = train, ids, labels
        self.middle = train.mean(0)     # far from the origin the fast form would lose its digits
        self.centred = train - self.middle
        self.lengths = (self.centred ** 2).sum(1)
        self.place = np.unique(ids, return_inverse=True)[1]

    def best(self, part: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
        """k nearest train rows of each test row; some test rows at a time, so that at most CELLS distances are held."""
        size = max(1, CELLS // len(self.train))
        for start in range(0, len(part), size):
            some = part.iloc[start:start + size]
            yield self._best(np.stack(some["x"].to_numpy()), some["id"].to_numpy(), k)

    def _best(self, test: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
        """Equal distances: the lower train id."""
        k = min(k, len(self.train))
        a = test - self.middle
        own = (a ** 2).sum(1)
        fast = a @ self.centred.T
        fast *= -2.0
        fast += own[:, None]
        fast += self.lengths
        # Every row the rounding of the fast form allows among the k nearest is compared exactly.
        slack = 1e-13 * (test.shape[1] + 8) * (own + self.lengths.max())
        limit = np.partition(fast, k - 1, axis=1)[:, k - 1] + 2 * slack
        row, near = np.nonzero(fast <= limit[:, None])
        exact = np.concatenate([((test[row[i:i + PAIRS]] - self.train[near[i:i + PAIRS]]) ** 2).sum(1) for i in range(0, len(row), PAIRS)])
        order = np.lexsort((self.place[near], exact, row))
        row, near, exact = row[order], near[order], exact[order]
        first = np.searchsorted(row, np.arange(len(test)))
        chosen = (first[:, None] + np.arange(k)).ravel()
        return pd.DataFrame({
            "id": np.repeat(ids, k), "label": self.labels[near[chosen]].astype(float),
            "neighbour": self.ids[near[chosen]], "distance": exact[chosen]})


def nearest(test: DataFrame, train: DataFrame, k: int = 7, features: str = "features",
            label: str = "label", key: str = "id", broadcast_bytes: int = BROADCAST_BYTES,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, label, neighbour, distance): the k nearest train rows per test row, squared distances."""
    spark = test.sparkSession
    te = test.select(F.col(key).alias("id"), vector_to_array(features).alias("x"))
    tr = train.select(F.col(key).alias("tid"), vector_to_array(features).alias("x"),
                      F.col(label).cast("double").alias("y"))
    size = tr.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    if not size["n"]:
        raise ValueError("no rows to compare with")

    out = f"id {dict(te.dtypes)['id']}, label double, neighbour {dict(tr.dtypes)['tid']}, distance double"
    if size["n"] * (size["d"] + 2) * 8 <= broadcast_bytes:
        rows = tr.toPandas()      # checked above to be small
        shared = spark.sparkContext.broadcast(
            (np.stack(rows["x"].to_numpy()), rows["tid"].to_numpy(), rows["y"].to_numpy()))

        def per_batch(batches):
            block = _Block(*shared.value)
            for pdf in batches:
                yield from block.best(pdf, k)

        return te.mapInPandas(per_batch, out)

    block_rows = max(1, min(block_rows, broadcast_bytes // ((size["d"] + 2) * 8)))
    blocks = max(1, -(-size["n"] // block_rows))
    tiles = max(1, -(-te.count() // block_rows))
    left = (te.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (tr.withColumn("block", F.pmod(F.xxhash64("tid"), F.lit(blocks)).cast("int"))
             .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))))

    def per_pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a["id"][:0], "label": np.empty(0), "neighbour": b["tid"][:0], "distance": np.empty(0)})
        block = _Block(np.stack(b["x"].to_numpy()), b["tid"].to_numpy(), b["y"].to_numpy())
        return pd.concat(list(block.best(a, k)))

    near = (left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block"))
            .applyInPandas(per_pair, out))
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return near.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def vote(near: DataFrame) -> DataFrame:
    """(id, score, prediction): share of positive neighbours and the majority."""
    return near.groupBy("id").agg(F.avg("label").alias("score")).withColumn(
        "prediction", (F.col("score") > 0.5).cast("double"))


def predict(test: DataFrame, train: DataFrame, k: int = 7, features: str = "features",
            label: str = "label", key: str = "id", **options) -> DataFrame:
    """`test` with `score` and `prediction`; its keys are unique."""
    found = vote(nearest(test, train, k, features, label, key, **options))
    return test.join(found.withColumnRenamed("id", "__id"), F.col(key) == F.col("__id")).drop("__id")
