import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from fieldmark.operators import classifiers, neighbors, reducers
from fieldmark.operators.clusters import fit_clusters
from fieldmark.operators.metrics import classification_metrics, roc_auc
from fieldmark.operators.preprocess import fit_numeric, fit_preprocess, most_frequent
from fieldmark.plans import runs
from fieldmark.plans.comparison import write_comparison
from fieldmark.plans.grid import SweepConfig
from fieldmark.plans.sweep import refit_best, sweep
from fieldmark.plans.targets import (feature_columns, missing_columns, score_targets, train_target)
from fieldmark.registry import TARGETS

SHORT = classifiers.Effort(linear_iterations=50, svm_iterations=30, trees=10, tree_depth=5, boosting_rounds=8,
                           network_iterations=60, fourier_features=128)


def _frame(spark, x, labels=None):
    labels = np.zeros(len(x)) if labels is None else labels
    rows = [(i, int(labels[i]), [float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, label int, a array<double>").select(
        "id", "label", array_to_vector("a").alias("features"))


def _matrix(df, column):
    return np.array([r["a"] for r in df.orderBy("id").select(vector_to_array(column).alias("a")).collect()])


@pytest.fixture(scope="module")
def mixed(spark):
    """Three independent sources, mixed."""
    rng = np.random.default_rng(3)
    s = np.column_stack([rng.uniform(-1, 1, 1500), rng.exponential(1, 1500), np.sign(rng.normal(size=1500))])
    return s, _frame(spark, s @ rng.normal(size=(3, 5)) + 4).cache()


def test_pca(mixed):
    _, df = mixed
    model = reducers.fit_pca(df, 3, "features", "z")
    z = _matrix(model.transform(df), "z")
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9)
    pc = model.stages[-1].pc.toArray()
    assert np.allclose(pc.T @ pc, np.eye(3), atol=1e-9)
    assert abs(sum(reducers.explained_variance(model)) - 1) < 1e-9      # rank 3
    assert reducers.fit_pca(df, 99, "features", "z").stages[-1].getK() == 5
    board = reducers.heaviest(reducers.loadings(model, list("abcde"), df.sparkSession), 2)
    assert board.count() == 6


def test_ica_finds_the_sources(mixed):
    s, df = mixed
    z = _matrix(reducers.fit_ica(df, 3, "features", "z").transform(df), "z")
    assert np.allclose(np.cov(z.T, bias=True), np.eye(3), atol=1e-6)
    match = np.abs(np.corrcoef(z.T, s.T)[:3, 3:])
    assert (match.max(axis=1) > 0.98).all() and (match.max(axis=0) > 0.98).all()


def test_random_projection(spark, mixed, tmp_path):
    _, df = mixed
    one = reducers.fit_random_projection(df, 2, "features", "z", seed=5)
    assert np.allclose(_matrix(one.transform(df), "z"), _matrix(df, "features") @ reducers.random_matrix(5, 2, 5))
    one.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert np.allclose(_matrix(again.transform(df), "z"), _matrix(one.transform(df), "z"))
    assert reducers.fit_reducer("none", df, 2, "features", "z") is None
    with pytest.raises(ValueError):
        reducers.fit_reducer("umap", df, 2, "features", "z")


def test_moments(mixed):
    _, df = mixed
    x = _matrix(df, "features")
    n, mean, cov = reducers.moments(df, "features")
    assert n == 1500 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T))


@pytest.mark.parametrize("kind", ["kmeans", "gmm"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(1)
    centers = np.array([[0, 0], [9, 0], [0, 9], [9, 9]])
    truth = np.repeat(range(4), 50)
    df = _frame(spark, centers[truth] + rng.normal(size=(200, 2)) * 0.3)
    out = _matrix(fit_clusters(kind, df, "features", "c", starts=3).transform(df), "c")
    assert out.shape == (200, 6) and (out[:, 2:].sum(axis=1) == 1).all()
    found = out[:, 2:].argmax(axis=1)
    assert len(set(zip(truth, found))) == 4
    assert fit_clusters("none", df, "features", "c") is None


def test_preprocess(spark):
    rows = [(float(i), None if i % 2 else float("nan"), 3.0, None, f"c{min(i, 55)}", "it's") for i in range(60)]
    train = spark.createDataFrame(rows, "n double, gap double, same double, none double, many string, one string")
    fits = fit_numeric(train, ["n", "same", "none", "gap"])
    assert set(fits) == {"n", "same"} and fits["same"].std == 1.0
    steps = fit_preprocess(train, ["n", "same", "none"], ["many", "one"])
    x = np.array([r[0] for r in steps.transform(train).select(vector_to_array("features")).collect()])
    assert x.shape == (60, 2 + 50 + 1)          # 49 kept, one shared column, one value
    assert np.allclose(x[:, 0].mean(), 0) and np.allclose(x[:, 0].std(), 1) and (x[:, 1] == 0).all()
    assert (x[:, 2:52].sum(axis=1) == 1).all() and (x[:, 52] == 1).all()
    assert x[:, 51].sum() == 56 - 49
    new = spark.createDataFrame([(None, 0.0, 3.0, 0.0, "unseen", "other"), (1.0, 0.0, 3.0, 0.0, "c55", "it's")],
                                train.schema)
    y = np.array([r[0] for r in steps.transform(new).select(vector_to_array("features")).collect()])
    y = y[np.argsort(y[:, 52])]
    assert y[0, 2:].sum() == 0 and y[0, 0] == 0     # zeros, and the median 29.5 = the mean
    assert y[1, 2] == 1 and y[1, 52] == 1            # c55 is the most frequent
    assert "__n0" not in steps.transform(new).columns
    assert most_frequent(train, ["many"]) == {"many": "c55"}


def test_neighbours_by_blocks_and_by_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).round(1)
    x[200:220] = x[:20]
    labels = rng.integers(0, 2, 300)
    df = _frame(spark, x, labels).cache()
    test, train = df.where("id >= 200"), df.where("id < 200")
    d = ((x[200:, None, :] - x[None, :200, :]) ** 2).sum(2)
    want = {200 + i: [int(j) for j in np.lexsort((np.arange(200), d[i]))[:7]] for i in range(100)}
    for options in ({}, {"broadcast_bytes": 3000, "block_rows": 37}):
        got = {}
        for r in neighbors.nearest(test, train, 7, **options).orderBy("id", "distance", "neighbour").collect():
            got.setdefault(r["id"], []).append(r["neighbour"])
        assert got == want
    scored = neighbors.predict(test, train).collect()
    assert all(abs(r["score"] - labels[want[r["id"]]].mean()) < 1e-12 for r in scored)


@pytest.mark.parametrize("name", classifiers.MODELS)
def test_classifiers_learn(spark, name):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    df = _frame(spark, x, (x[:, 0] + 0.5 * x[:, 1] > 0)).cache()
    model = classifiers.fit(name, df.where("id < 240"), effort=SHORT)
    scored = model.predict(df.where("id >= 240")).cache()
    assert scored.count() == 60
    assert roc_auc(scored, "label", "score").first()["roc_auc"] > 0.85
    assert classification_metrics(scored, "label", "prediction").first()["accuracy"] > 0.75


def test_auc_edge_cases(spark):
    df = spark.createDataFrame([(1, 0.5, "a"), (0, 0.5, "a"), (1, float("nan"), "a"), (1, 0.1, "b")],
                               "label int, score double, g string")
    got = {r["g"]: r["roc_auc"] for r in roc_auc(df, "label", "score", ["g"]).collect()}
    assert got == {"a": 0.5, "b": None}
    none = spark.createDataFrame([(0, 0.0)], "label int, prediction double")
    assert classification_metrics(none, "label", "prediction").first()["f1"] == 0.0


def test_sweep_and_refit(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal() + i % 2 * 2), float(rng.normal()), str(rng.choice(list("xyz"))), i % 2)
            for i in range(200)]
    silver = spark.createDataFrame(rows, "id long, a double, b double, c string, label int")
    cfg = SweepConfig(datasets=("d", "absent", "broken"), reducers=("none", "pca"), n_components=(2,),
                      clustering=("none", "kmeans"), models=("logistic_regression", "knn", "nope"),
                      cv_folds=2, sample_rows=150)
    data = {"d": silver, "broken": silver.drop("label")}
    board = sweep(spark, data, cfg, effort=SHORT, runs_path=str(tmp_path / "runs"))
    rows = board.collect()
    assert len(rows) == 8 and all(r["cv_roc_auc"] > 0.7 for r in rows)
    assert all((r["pca_explained_var"] is not None) == (r["reducer"] == "pca") for r in rows)
    log = runs.read_runs(spark, str(tmp_path / "runs"))
    assert log.where("status = 'FAILED'").count() == 4 + 1
    assert log.where("name = 'grid_sweep'").count() == 1
    for model, sub in (("logistic_regression", ""), ("knn", "/features")):
        path = refit_best(spark, board.where(F.col("model") == model), data, cfg, str(tmp_path / model),
                          effort=SHORT)["d"]
        assert PipelineModel.load(path + sub).transform(silver).count() == 200
    with pytest.raises(RuntimeError):
        sweep(spark, {"d": silver}, SweepConfig(datasets=("d",), reducers=("none",), clustering=("none",),
                                                models=("nope",), cv_folds=2), effort=SHORT)


def test_failing_cell_is_no_shorter_board(spark, tmp_path, monkeypatch):
    """Without a run log a board that lacks cells would look whole: the sweep fails, after it tried every cell."""
    from fieldmark.plans import sweep as plan

    silver = spark.createDataFrame([(i, float(i % 2 + i % 7), i % 2) for i in range(60)], "id long, a double, label int")
    one, tried = plan.run_cell, []

    def run(cell, parts, effort):
        tried.append(cell.model)
        if cell.model == "svm_linear":
            raise MemoryError("lost executor")
        return one(cell, parts, effort)

    monkeypatch.setattr(plan, "run_cell", run)
    cfg = SweepConfig(datasets=("d",), reducers=("none",), clustering=("none",), cv_folds=2, sample_rows=0,
                      models=("svm_linear", "knn"))
    with pytest.raises(RuntimeError, match="none.k-1.none.svm_linear.*lost executor"):
        sweep(spark, {"d": silver}, cfg, effort=SHORT)
    assert sorted(tried) == ["knn", "svm_linear"]
    assert [r["model"] for r in sweep(spark, {"d": silver}, cfg, effort=SHORT, runs_path=str(tmp_path / "runs")).collect()] == ["knn"]
    log = runs.read_runs(spark, str(tmp_path / "runs")).where("status = 'FAILED'").collect()
    assert [(r["model"], r["params"]["error"]) for r in log] == [("svm_linear", "lost executor")]
    broken = SweepConfig(datasets=("d", "e"), reducers=("none",), clustering=("none",), cv_folds=2, models=("knn",))
    with pytest.raises(RuntimeError, match="failed.*: e;"):
        sweep(spark, {"d": silver, "e": silver.drop("label")}, broken, effort=SHORT)


def _team_games(spark, n=160):
    rng = np.random.default_rng(6)
    form = rng.normal(size=n)
    rows = [("golf", f"g{i:03d}", "t", float(form[i]), None if i == 5 else float(rng.normal()),
             float(form[i] * 3 + rng.normal() * 0.1), 1.0, int(form[i] > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "sport string, game_id string, team string, form_points_for double, "
                                       "form_win_rate double, points_for double, points_against double, win int")


def test_targets(spark, tmp_path):
    table = _team_games(spark)
    win, points = TARGETS["win_probability"], TARGETS["points_for"]
    assert missing_columns(TARGETS["player_index"], None) == ["athlete_metrics (table)"]
    assert missing_columns(TARGETS["off_efficiency"], table) == ["off_efficiency"]
    assert feature_columns(table, win) == ["form_points_for", "form_win_rate"]
    assert set(feature_columns(table, win, strict=True)) == {"form_points_for", "form_win_rate", "points_for",
                                                             "points_against"}
    models, aliases, log = (str(tmp_path / n) for n in ("models", "aliases", "runs"))
    assert score_targets(spark, {"team_game_features": table}, "golf", aliases) is None
    first = train_target(table, win, "golf", models, aliases, log, rounds=8)
    assert first["roc_auc"] > 0.9 and first["model_version"] == 1
    assert train_target(table, win, "golf", models, aliases, log, rounds=3)["model_version"] == 2
    train_target(table, points, "golf", models, aliases, log, rounds=8)
    out = score_targets(spark, {"team_game_features": table}, "golf", aliases, str(tmp_path / "scored"))
    assert out.count() == 320
    stored = spark.read.parquet(str(tmp_path / "scored"))
    assert {r[0] for r in stored.select("target").distinct().collect()} == {"win_probability", "points_for"}
    logged = runs.metric_columns(runs.read_runs(spark, log), ["roc_auc", "rmse"])
    assert logged.where("roc_auc IS NOT NULL").count() == 2 and logged.where("rmse IS NOT NULL").count() == 1


def test_comparison(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", "golf_yolo_pose", "FINISHED", 1, 0.5), ("b", "golf_yolo_pose", "FINISHED", 2, float("nan")),
         ("c", "golf_yolo_pose", "RUNNING", 3, 0.9), ("d", "golf_other", "FINISHED", 1, 0.1)],
        "run_id string, name string, status string, start_time int, pose_map double")
    path = write_comparison(spark, df, "golf", str(tmp_path / "cmp"))
    rows = spark.read.parquet(path).collect()
    assert [(r["run_id"], r["pose_map"], r["mpjpe_mm"]) for r in rows] == [("b", None, None)]
    with pytest.raises(RuntimeError):
        write_comparison(spark, df, "tennis", str(tmp_path / "cmp"))


def test_rounds_in_one_task_and_by_jobs_agree(spark, monkeypatch):
    from fieldmark.operators import mixture, reducers

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.laplace(size=(40, 3)), rng.laplace(size=(40, 3)) + 6.0]) @ rng.normal(size=(3, 3))
    df = _frame(spark, x).repartition(3)
    made = []
    for cells in (10_000, 0):
        monkeypatch.setattr(reducers, "TASK_CELLS", cells)
        ica = reducers.fit_ica(df, 3, "features", "out").stages[0]
        gmm = mixture.fit_mixture(df.coalesce(1), 2, "features", "cluster")
        made.append((ica.matrix(), np.array(gmm.getOrDefault(gmm.means)), np.array(gmm.getOrDefault(gmm.logWeights))))
    for one, other in zip(*made):
        assert np.allclose(one, other, rtol=1e-6, atol=1e-8)


def test_mixture_with_fewer_rows_than_columns(spark):
    """A covariance without full rank must not spoil the fit."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(12, 20)), rng.normal(size=(12, 20)) + 30])
    out = _matrix(fit_clusters("gmm", _frame(spark, x), "features", "c", k=2).transform(_frame(spark, x)), "c")
    found = out[:, 20:].argmax(axis=1)
    assert len(set(found[:12])) == len(set(found[12:])) == 1 and found[0] != found[12]


def _points(spark, n=60):
    from pyspark.ml.linalg import Vectors

    rows = [(i, float(i % 2), Vectors.dense([i % 2 + i / 100, (i * 7 % 5) / 5])) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "label", "features"])


@pytest.mark.parametrize("name", ["logistic_regression", "svm_rbf", "svm_linear", "random_forest", "mlp"])
def test_classifiers_fit_in_an_observed_session(spark, name):
    from pyspark.sql import Observation
    from fieldmark.operators import classifiers
    from fieldmark.operators.quality import Rules

    Rules({"positive": "id > 0"}).observe(spark.range(10), Observation()).count()
    few = classifiers.Effort(20, 20, 5, 3, 3, 20, 16)
    points = _points(spark)
    assert classifiers.fit(name, points, effort=few).predict(points).where("prediction = label").count() >= 50


@pytest.mark.parametrize("limit", [10**9, 2_000])
def test_equal_neighbours_go_to_the_lower_id(spark, limit):
    from pyspark.ml.linalg import Vectors
    from fieldmark.operators import neighbors

    train = spark.createDataFrame([(f"k{i:03d}", 1.0, Vectors.dense([1e8, 1e8 + (i >= 200)])) for i in range(400)], ["id", "label", "features"])
    test = spark.createDataFrame([("t", 0.0, Vectors.dense([1e8, 1e8]))], ["id", "label", "features"])
    found = neighbors.nearest(test, train, 7, broadcast_bytes=limit).orderBy("distance", "neighbour").collect()
    assert [r["neighbour"] for r in found] == [f"k{i:03d}" for i in range(7)]


def test_missing_category_is_the_most_frequent(spark):
    from fieldmark.operators.preprocess import fit_preprocess

    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string").withColumn("x", F.lit(1.0))
    out = fit_preprocess(df, ["x"], ["c"]).transform(df).select("c", "features").collect()
    by = {r["c"]: r["features"].toArray().tolist() for r in out}
    assert by[None] == by["a"] != by["b"]


def test_registered_targets_are_trained_for_every_sport_with_all_rounds(spark, monkeypatch):
    from fieldmark.catalog import learning

    asked = []
    monkeypatch.setattr(learning, "train_targets", lambda table, jobs, *paths, parallel: asked.extend((s, t.key, {}) for t, s in jobs))
    learning._train_all(spark, "/root/testdata/sf0.001")
    ready = ["win_probability", "points_for", "points_against", "off_efficiency", "def_efficiency"]
    assert sorted(asked, key=str) == sorted(((s, k, {}) for s in "FOP" for k in ready), key=str)


def test_registered_grid_is_whole(spark, monkeypatch):
    from fieldmark.catalog import learning

    asked = []
    monkeypatch.setattr(learning, "sweep", lambda spark, data, cfg, **more: asked.append((data["embeddings"].columns, cfg, more)))
    monkeypatch.setattr(learning, "refit_best", lambda *args, **more: {})
    monkeypatch.setattr(learning.lb, "sort_leaderboard", lambda board, ties: board)
    learning.cv_leaderboard(spark, "/root/testdata/sf0.001")
    with pytest.raises(KeyError):
        learning.best_refit(spark, "/root/testdata/sf0.001")
    for columns, cfg, more in asked:
        assert {f"e{i}" for i in range(64)} <= set(columns) and not more
        assert set(cfg.reducers) == {"none", "pca", "ica", "random_projection"}
        assert set(cfg.clustering) == {"none", "kmeans", "gmm"} and set(cfg.models) == set(classifiers.MODELS)


@pytest.mark.parametrize("model", ["knn", "logistic_regression"])
def test_best_cell_is_applied(spark, tmp_path, model):
    from fieldmark.catalog import learning

    silver = spark.createDataFrame([(i, float(i % 2 * 5 + i % 7), float(i % 3), i % 2) for i in range(80)],
                                   "id long, a double, b double, label int")
    cfg = SweepConfig(datasets=("d",), reducers=("pca",), n_components=(2,), clustering=("kmeans",),
                      models=(model,), cv_folds=2, sample_rows=0)
    board = sweep(spark, {"d": silver}, cfg, effort=SHORT)
    path = refit_best(spark, board, {"d": silver}, cfg, str(tmp_path / model), effort=SHORT)["d"]
    rows = learning._apply_best(spark, path, learning._best_model(board), silver).collect()
    assert len(rows) == 80 and {r["prediction"] for r in rows} == {0.0, 1.0}


def test_neighbours_hold_few_distances_at_once():
    """1,500 test rows against 4,000 train rows: beside the rows only some of the distances are in memory."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(5)
    train, test = rng.integers(0, 3, (4_000, 4)).astype(float), rng.integers(0, 3, (1_500, 4)).astype(float)
    part = pd.DataFrame({"id": np.arange(1_500), "x": list(test)})
    tracemalloc.start()
    found = pd.concat(list(neighbors._Block(train, np.arange(4_000)[::-1], np.zeros(4_000)).best(part, 7)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_500 * 4_000 * 8 * 1.5
    distance = ((test[:20, None, :] - train[None, :, :]) ** 2).sum(2)
    for i in range(20):
        order = np.lexsort((np.arange(4_000)[::-1], distance[i]))[:7]
        mine = found[found["id"] == i]
        assert mine["neighbour"].tolist() == (3_999 - order).tolist() and mine["distance"].tolist() == distance[i][order].tolist()


def test_starts_of_k_means_in_one_task(spark, tmp_path):
    """One job for all starts of rows that fit a task, at most the cost of Spark's starts; the model is saved like Spark's."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) + 8 * np.eye(4, 3)[rng.integers(0, 4, 200)]
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["id", "x"]).cache()
    df.count()

    def members(model) -> np.ndarray:
        rows = model.transform(df).orderBy("id").select(vector_to_array("c").alias("c")).collect()
        return np.array([r["c"] for r in rows])[:, 3:].argmax(axis=1)

    def cost(found: np.ndarray) -> float:
        return sum(((x[found == g] - x[found == g].mean(axis=0)) ** 2).sum() for g in set(found.tolist()))

    spark.sparkContext.setJobGroup("starts", "k-means")
    model = fit_clusters("kmeans", df, "x", "c", rows=200)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("starts"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 3
    found = members(model)
    assert cost(found) <= cost(members(fit_clusters("kmeans", df, "x", "c"))) * (1 + 1e-9)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert (members(PipelineModel.load(str(tmp_path / "m"))) == found).all()
    same = spark.createDataFrame([(i, Vectors.dense([float(i % 2)])) for i in range(6)], ["id", "x"])
    rows = fit_clusters("kmeans", same, "x", "c", rows=6).transform(same).select("id", vector_to_array("c").alias("c")).collect()
    assert len({tuple(r["c"]) for r in rows}) == 2


def _clouds(spark, n=300, d=4):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(12)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, d)) + y[:, None] * np.linspace(0.2, 1.2, d)
    return x, y, spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i])) for i in range(n)], ["id", "label", "features"]).cache()


@pytest.mark.parametrize("name", ["logistic_regression", "mlp"])
def test_counted_rows_train_in_one_task(spark, tmp_path, name):
    """Few jobs whatever the steps, at most the loss that Spark's learner reaches, saved like Spark's."""
    x, y, df = _clouds(spark)
    df.count()
    effort = classifiers.Effort(linear_iterations=200, network_iterations=40)

    def loss(model) -> float:
        p = np.array([r["score"] for r in model.predict(df).orderBy("id").collect()]).clip(1e-12, 1 - 1e-12)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    spark.sparkContext.setJobGroup("steps", name)
    model = classifiers.fit(name, df, effort=effort, rows=300)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("steps"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 5
    other = classifiers.fit(name, df, effort=effort)
    assert loss(model) <= loss(other) * (1 + (1e-4 if name == "logistic_regression" else 0.25))
    if name == "logistic_regression":
        assert np.allclose(model.model.stages[0].coefficients.toArray(), other.model.stages[0].coefficients.toArray(), atol=2e-3)
    model.model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(df).orderBy("id").select("prediction").collect()
    assert [r[0] for r in again] == [r["prediction"] for r in model.predict(df).orderBy("id").collect()]


def test_network_slopes_and_steps():
    from fieldmark.operators import networks

    rng = np.random.default_rng(3)
    x, label, layers = rng.normal(size=(40, 3)), rng.integers(0, 2, 40).astype(float), [3, 5, 4, 2]
    size = sum((i + 1) * o for i, o in zip(layers, layers[1:]))
    loss, w = networks._loss_of(x, label, layers), rng.normal(size=size)
    value, slope = loss(w)
    for i in range(size):
        step = np.eye(size)[i] * 1e-6
        assert abs((loss(w + step)[0] - loss(w - step)[0]) / 2e-6 - slope[i]) < 1e-7
    assert loss(networks.descend(loss, w, 200))[0] < value / 10
    valley = lambda v: (float(100 * (v[1] - v[0] ** 2) ** 2 + (1 - v[0]) ** 2),
                        np.array([-400 * v[0] * (v[1] - v[0] ** 2) - 2 * (1 - v[0]), 200 * (v[1] - v[0] ** 2)]))
    assert np.allclose(networks.descend(valley, np.array([-1.2, 1.0]), 200), 1, atol=1e-2)
    one = networks.solve_line(x, np.ones(40), 1 / 40, 100)      # labels of one kind
    assert np.isfinite(one).all() and one[-1] > 5


@pytest.mark.parametrize("name", ["logistic_regression", "mlp"])
def test_missing_labels_and_values_are_refused_in_one_task_as_by_spark(spark, name):
    few = classifiers.Effort(linear_iterations=5, network_iterations=5)
    points = _points(spark)
    for bad in (points.withColumn("label", F.when(F.col("id") != 7, F.col("label"))),
                points.withColumn("features", F.when(F.col("id") != 7, F.col("features")).otherwise(
                    array_to_vector(F.array(F.lit(float("nan")), F.lit(0.0)))))):
        for rows in (60, None):
            with pytest.raises(Exception, match="(?i)must not be"):
                classifiers.fit(name, bad, effort=few, rows=rows)
