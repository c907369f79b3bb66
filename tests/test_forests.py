import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fieldmark.operators import classifiers, forests


def _walk(tree: pd.DataFrame, row) -> float:
    node = 0
    while tree.feature[node] >= 0:
        node = tree.child[node] + int(row[tree.feature[node]] > tree.cut[node])
    return tree.value[node]


def test_best_cut_is_the_least_impure_one():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(2, 12), rng.integers(1, 4)
        x = rng.integers(0, 4, (n, m)).astype(float)
        w, y = rng.integers(1, 4, n).astype(float), rng.integers(0, 2, n).astype(float)

        def impurity(column, cut):
            total = 0.0
            for side in (x[:, column] <= cut, x[:, column] > cut):
                a, b = w[side].sum(), (w * y)[side].sum()
                total += b * (a - b) / a
            return total
        every = [(c, v) for c in range(m) for v in np.unique(x[:, c])[:-1]]
        found = forests.best_cut(x, w, w * y)
        assert (found is None) == (not every)
        if found:
            assert abs(impurity(*found) - min(impurity(*e) for e in every)) < 1e-9


def test_trees_are_pure_and_as_deep_as_needed():
    x, y = np.arange(64.0)[:, None], (np.arange(64) % 2).astype(float)      # every neighbour differs
    tree = forests.grow_tree(x, y, np.random.default_rng(1), 100)
    assert set(tree.value[tree.feature < 0]) <= {0.0, 1.0}
    flat = forests.grow_tree(x, y, np.random.default_rng(1), 0)
    assert len(flat) == 1
    same = forests.grow_tree(np.zeros((5, 3)), np.array([0, 1, 0, 1, 1.0]), np.random.default_rng(1), 9)
    assert len(same) == 1


def test_forest_scores_like_its_trees_whatever_the_blocks(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(zip(x.tolist(), y.tolist()))], "id long, a array<double>, label double") \
        .select("id", array_to_vector("a").alias("features"), "label").cache()
    monkeypatch.setattr(forests, "BLOCK", 4)
    effort = classifiers.Effort(trees=10, tree_depth=30)
    model = classifiers.fit("random_forest", df, effort=effort)
    got = model.predict(df).orderBy("id").toPandas()
    order = np.lexsort([y, *x.T[::-1]])
    trees = [forests.grow_tree(x[order], y[order], np.random.default_rng([42, t]), 30) for t in range(10)]
    want = np.array([np.mean([_walk(t, r) for t in trees]) for r in x])
    assert np.allclose(got.score, want, atol=1e-12) and ((got.score > 0.5) == (got.prediction == 1)).all()
    assert (got.prediction == got.label).mean() > 0.95
    monkeypatch.setattr(forests, "BLOCK", 50)
    again = classifiers.fit("random_forest", df.orderBy(F.desc("id")), effort=effort)
    again.model.write().overwrite().save(str(tmp_path / "m"))
    read = classifiers.Fitted(PipelineModel.load(str(tmp_path / "m"))).predict(df).orderBy("id").toPandas()
    assert np.allclose(read.score, want, atol=1e-12)


def test_forest_of_many_rows_stays_in_files(spark, monkeypatch, tmp_path):
    """No node reaches the driver, scores are those of the trees, and a saved model brings its trees along."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 5)), 1)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(zip(x.tolist(), y.tolist()))], "id long, a array<double>, label double") \
        .select("id", array_to_vector("a").alias("features"), "label").cache()
    monkeypatch.setattr(forests, "MODEL_ROWS", 100)
    monkeypatch.setattr(forests, "TILE_ROWS", 40)
    model = classifiers.fit("random_forest", df, effort=classifiers.Effort(trees=23, tree_depth=30))
    assert isinstance(model.model.stages[0], forests.StoredForest)
    order = np.lexsort([y, *x.T[::-1]])
    trees = [forests.grow_tree(x[order], y[order], np.random.default_rng([42, t]), 30) for t in range(23)]
    want = np.array([np.mean([_walk(t, r) for t in trees]) for r in x])
    got = model.predict(df.unionByName(df.where("id < 7"))).orderBy("id").toPandas()
    assert len(got) == 157 and np.allclose(got.score, want[got.id], atol=1e-12) and ((got.score > 0.5) == (got.prediction == 1)).all()
    model.model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert loaded.stages[0].getOrDefault("path").startswith(str(tmp_path))
    read = classifiers.Fitted(loaded).predict(df).orderBy("id").toPandas()
    assert np.allclose(read.score, want, atol=1e-12)
