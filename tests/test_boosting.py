"""Boosted trees: both ways of growing against a plain booster over raw values."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fieldmark.operators import boosting
from fieldmark.operators.boosting import Growth


def _data(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)           # few distinct values: each is a bin, and there are ties
    x[:, 3] = 2.0                                      # a constant feature
    y = np.round(3 * x[:, 0] * (x[:, 1] > 0) + x[:, 2] + rng.normal(size=n) * 0.1, 3)
    return x, y


def _frame(spark, problems):
    rows = [(name, Vectors.dense(row), float(v)) for name, (x, y) in problems.items() for row, v in zip(x, y)]
    return spark.createDataFrame(rows, ["problem", "features", "label"]).repartition(5)


def _plain(x, y, kind, growth):
    """Margins of a booster that tries every value of every feature as a cut, node by node."""
    mean = y.mean()
    margin = np.full(len(y), np.log(mean / (1 - mean)) if kind == "classification" else mean)

    def grow(rows, g, h, depth):
        def leaf(r):
            return -growth.rate * g[r].sum() / (h[r].sum() + growth.penalty)

        def part(r):
            return g[r].sum() ** 2 / (h[r].sum() + growth.penalty)

        best = (1e-9, None)
        for f in range(x.shape[1]) if depth else ():
            for cut in np.unique(x[rows, f]):
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if len(right) and min(h[left].sum(), h[right].sum()) >= growth.least_hessian:
                    gain = (part(left) + part(right) - part(rows)) / 2
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if best[1] is None:
            return [(rows, leaf(rows))]
        return [y for side in best[1] for y in grow(side, g, h, depth - 1)]

    for _ in range(growth.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y, p * (1 - p)) if kind == "classification" else (margin - y, np.ones(len(y)))
        for rows, value in grow(np.arange(len(y)), g, h, growth.depth):
            margin[rows] += value
    return margin


@pytest.mark.parametrize("cells", [boosting.TASK_CELLS, 0, 900])
def test_trees_equal_a_plain_booster(spark, cells, monkeypatch):
    """All rows in one task, all rows apart (margins written in between), and one problem of each."""
    monkeypatch.setattr(boosting, "SETTLE_EVERY", 2)
    x, y = _data()
    problems = {"points": (x, y), "win": (x[:200], (y[:200] > 0).astype(float))}
    growth = Growth(rounds=5, depth=3, rate=0.3)
    kinds = {"points": "regression", "win": "classification"}
    found = boosting.grow(_frame(spark, problems), kinds, growth, task_cells=cells)
    for name, (a, b) in problems.items():
        assert np.allclose(found[name].margins(a), _plain(a, b, kinds[name], growth), atol=1e-5), name


def test_both_ways_grow_the_same_trees(spark):
    """Also with rows and features left out by tree, and a feature of more values than bins."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 5))
    problems = {"a": (x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)), "b": (x[:500], (x[:500, 4] > 0.3).astype(float))}
    growth = Growth(rounds=6, depth=4, rate=0.1, rows=0.9, columns=0.7)
    df = _frame(spark, problems)
    df = spark.createDataFrame(df.collect(), df.schema).cache()
    kinds = dict.fromkeys(problems, "classification")
    here, apart = boosting.grow(df, kinds, growth), boosting.grow(df, kinds, growth, task_cells=0)
    for name in problems:
        for part in ("feature", "threshold", "value"):
            assert here[name].getOrDefault(part) == apart[name].getOrDefault(part), (name, part)


def test_saved_trees_score_alike(spark, tmp_path):
    x, y = _data(120)
    df = _frame(spark, {"p": (x, (y > 0).astype(float))})
    model = boosting.grow(df, {"p": "classification"}, Growth(rounds=20, depth=3, rate=0.3))["p"]
    PipelineModel([model]).save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m")).transform(df)
    rows = loaded.select("label", "prediction", vector_to_array("probability").alias("p"), "features").collect()
    assert sum(r["label"] == r["prediction"] for r in rows) > 110
    margins = model.margins(np.array([r["features"].toArray() for r in rows]))
    assert np.allclose([r["p"][1] for r in rows], 1 / (1 + np.exp(-margins))) and all(abs(sum(r["p"]) - 1) < 1e-12 for r in rows)


def test_labels_missing_or_all_alike(spark):
    x, y = _data(40)
    df = _frame(spark, {"one": (x, np.ones(40)), "flat": (x, np.full(40, 3.5))})
    df = df.unionByName(df.limit(3).withColumn("label", F.lit(None).cast("double")))
    found = boosting.grow(df, {"one": "classification", "flat": "regression"}, Growth(rounds=3))
    assert np.allclose(found["flat"].margins(x), 3.5) and (found["one"].margins(x) > 3).all()


@pytest.mark.parametrize("cells", [boosting.TASK_CELLS, 0])
def test_rows_of_the_same_bins_are_grown_as_one(spark, cells):
    """Six copies of each row, one in six with another label: few rows are left, trees are those of all rows."""
    x, y = _data(150, seed=4)
    x, y = np.repeat(x, 6, axis=0), np.repeat(y, 6) + np.tile([0, 0, 0, 0, 0, 1.5], 150)
    problems = {"points": (x, y), "win": (x, (y > 0).astype(float))}
    kinds = {"points": "regression", "win": "classification"}
    growth = Growth(rounds=4, depth=3, rate=0.3)
    found = boosting.grow(_frame(spark, problems), kinds, growth, task_cells=cells, merge_rows=100)
    for name, (a, b) in problems.items():
        assert np.allclose(found[name].margins(a), _plain(a, b, kinds[name], growth), atol=1e-5), name


def test_merged_rows_reach_tasks_with_their_weight(spark):
    x, y = _data(150, seed=4)
    df = _frame(spark, {"p": (np.repeat(x, 6, axis=0), np.repeat(y, 6))})
    growth = Growth(rounds=3, depth=3, rate=0.3)
    merged = boosting.grow(df, {"p": "regression"}, growth, task_cells=150 * 4, merge_rows=100)["p"]
    apart = boosting.grow(df, {"p": "regression"}, growth, task_cells=0, merge_rows=100)["p"]
    assert merged.getOrDefault("value") == apart.getOrDefault("value")
