"""Queries: splits, reducers, clusters, classifiers, the sweep, prediction targets."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.catalog.base import Tables, query
from fieldmark.catalog.labels import _features
from fieldmark.operators import classifiers, neighbors, reducers, splits
from fieldmark.operators import leaderboard as lb
from fieldmark.operators.clusters import fit_clusters
from fieldmark.operators.metrics import classification_metrics, roc_auc
from fieldmark.operators.preprocess import fit_preprocess
from fieldmark.plans import runs as run_tables
from fieldmark.plans.grid import SweepConfig
from fieldmark.plans.sweep import refit_best, sweep
from fieldmark.plans.targets import missing_columns
from fieldmark.plans.targets import score_targets as score_all
from fieldmark.plans.targets import train_targets
from fieldmark.registry import TARGETS
from fieldmark.session import scratch_path, settle

# --- splits, ordered by the key so that SQL can follow ------------------------

# Class sizes and the largest-remainder share of a total, per class.
_QUOTA = """
    n AS (SELECT {label} AS c, count(*) AS s FROM {table} GROUP BY 1),
    e AS (SELECT c, s, {total} * s::DOUBLE / sum(s) OVER () AS x, {total} AS total FROM n),
    f AS (SELECT c, floor(x) AS q, total - sum(floor(x)) OVER () AS rest,
                 row_number() OVER (ORDER BY floor(x) - x, CAST(c AS VARCHAR)) AS o FROM e),
    quota AS (SELECT c, q + CASE WHEN o <= rest THEN 1 ELSE 0 END AS q FROM f)"""


@query("WITH " + _QUOTA.format(label="quality", table="labels",
                               total="(SELECT ceil(0.2::DOUBLE * count(*)) FROM labels)") + """
    SELECT doc_id, quality, CAST(row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= q AS INTEGER) AS is_test
    FROM labels JOIN quota ON c = quality""")
def stratified_split(spark, sf):
    out = splits.hold_out(Tables(spark, sf).labels, "quality", "doc_id", 0.2, seed=None)
    return out.select("doc_id", "quality", F.col("is_test").cast("int").alias("is_test"))


@query("WITH " + _QUOTA.format(label="c_mktsegment", table="customer", total="400") + """
    SELECT c_custkey, c_mktsegment FROM customer JOIN quota ON c = c_mktsegment
    QUALIFY (SELECT count(*) FROM customer) <= 400
         OR row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= q""")
def row_cap(spark, sf):
    """At most 400 customers, every segment in proportion."""
    customers = Tables(spark, sf).customer.select("c_custkey", "c_mktsegment")
    return splits.row_cap(customers, "c_mktsegment", "c_custkey", 400, seed=None)


@query("""
    WITH n AS (SELECT quality AS c, count(*) AS s,
                      coalesce(sum(count(*)) OVER (ORDER BY quality ROWS BETWEEN UNBOUNDED PRECEDING
                                                   AND 1 PRECEDING), 0) AS start FROM labels GROUP BY 1),
    sizes AS (SELECT c, f.f, len(list_filter(range(CAST(start AS BIGINT), CAST(start + s AS BIGINT)),
                                             lambda p: p % 5 = f.f)) AS k
              FROM n, (SELECT unnest(range(5)) AS f) f),
    ends AS (SELECT c, f, sum(k) OVER (PARTITION BY c ORDER BY f) AS upto FROM sizes),
    r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels)
    SELECT doc_id, quality, CAST((SELECT count(*) FROM ends WHERE c = quality AND upto < r) AS INTEGER) AS fold
    FROM r""")
def fold_sizes(spark, sf):
    return splits.folds(Tables(spark, sf).labels, "quality", "doc_id", 5, seed=None).select(
        "doc_id", "quality", "fold")


# --- reducers -----------------------------------------------------------------

def vectors(t: Tables) -> DataFrame:
    """Embeddings as vectors; the upper half of the labels is the positive class."""
    return t.embeddings.select(
        F.col("vec_id").alias("id"), (F.col("label") > 4).cast("int").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _components(df: DataFrame, column: str, digits: int) -> DataFrame:
    return df.select("id", F.posexplode(vector_to_array(column)).alias("component", "value")).withColumn(
        "value", F.round("value", digits))


_MATRIX = reducers.random_matrix(64, 10, 42)


@query("WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)\n" + " UNION ALL ".join(
    f"SELECT id, {c} AS component, round(list_dot_product(e, "
    f"[{', '.join(repr(float(v)) for v in _MATRIX[:, c])}]::DOUBLE[]), 6) AS value FROM p" for c in range(10)))
def random_projection(spark, sf):
    df = vectors(Tables(spark, sf))
    model = reducers.fit_random_projection(df, 10, "features", "reduced", seed=42)
    return _components(model.transform(df), "reduced", 6)


@query("""
    WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)
    SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.v, b.v), 9) AS cov
    FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY 1, 2""")
def covariance_matrix(spark, sf):
    out = reducers.covariance_rows(vectors(Tables(spark, sf)), "features")
    return out.withColumn("cov", F.round("cov", 9))


@query()
def pca_project(spark, sf):
    df = vectors(Tables(spark, sf))
    return _components(reducers.fit_pca(df, 10, "features", "reduced").transform(df), "reduced", 9)


@query("""
    WITH x AS (SELECT unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
    d AS (SELECT i, var_samp(v) AS s FROM x GROUP BY 1)
    SELECT round(sum(s), 9) AS variance, 1.0::DOUBLE AS share FROM d""")
def explained_variance(spark, sf):
    """All components together hold all the variance."""
    df = vectors(Tables(spark, sf))
    model = reducers.fit_pca(df, None, "features", "reduced")
    share = sum(reducers.explained_variance(model))
    spread = _components(model.transform(df), "reduced", 15).groupBy("component").agg(
        F.var_samp("value").alias("s"))
    return spread.agg(F.round(F.sum("s"), 9).alias("variance"), F.round(F.lit(share), 9).alias("share"))


@query()
def pca_loadings(spark, sf):
    """The ten heaviest features per component."""
    model = reducers.fit_pca(vectors(Tables(spark, sf)), 10, "features", "reduced")
    return reducers.heaviest(reducers.loadings(model, [f"e{i}" for i in range(64)], spark))


@query("""
    SELECT CAST(i.i AS INTEGER) AS i, CAST(j.j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS cov,
           (SELECT count(*) FROM embeddings) AS rows
    FROM (SELECT unnest(range(10)) AS i) i, (SELECT unnest(range(10)) AS j) j""")
def ica_project(spark, sf):
    """Independent components are uncorrelated and of unit variance."""
    df = vectors(Tables(spark, sf))
    model = reducers.fit_ica(df, 10, "features", "reduced")
    n, _, cov = reducers.moments(model.transform(df).select("reduced"), "reduced")
    rows = [(i, j, abs(round(float(cov[i, j]) * (n - 1) / n, 6)), n) for i in range(10) for j in range(10)]
    return spark.createDataFrame(rows, "i int, j int, cov double, rows long")


@query()
def ica_components(spark, sf):
    df = vectors(Tables(spark, sf))
    return _components(reducers.fit_ica(df, 10, "features", "reduced").transform(df), "reduced", 6)


@query("""SELECT vec_id AS id, CAST(i.i AS INTEGER) AS component, CAST(embedding[i.i + 1] AS DOUBLE) AS value
          FROM embeddings, (SELECT unnest(range(64)) AS i) i""")
def passthrough(spark, sf):
    """The reducer `none` is no step at all."""
    df = vectors(Tables(spark, sf))
    assert reducers.fit_reducer("none", df, 10, "features", "reduced") is None
    return df.select("id", F.posexplode(vector_to_array("features")).alias("component", "value"))


# --- clusters -----------------------------------------------------------------

def _members(df: DataFrame) -> DataFrame:
    x = vector_to_array("clustered")
    return df.select("id", (F.array_position(F.slice(x, 65, 4), 1.0) - 1).cast("int").alias("cluster"),
                     F.size(x).alias("width"))


@query()
def kmeans_features(spark, sf):
    df = vectors(Tables(spark, sf))
    return _members(fit_clusters("kmeans", df, "features", "clustered").transform(df))


@query()
def gmm_features(spark, sf):
    df = vectors(Tables(spark, sf))
    return _members(fit_clusters("gmm", df, "features", "clustered").transform(df))


# --- classifiers --------------------------------------------------------------

@query("""
    WITH q AS (SELECT label > 4 AS c, count(*) AS s FROM embeddings GROUP BY 1),
    e AS (SELECT c, s, (SELECT ceil(0.2::DOUBLE * count(*)) FROM embeddings) * s::DOUBLE / sum(s) OVER () AS x FROM q),
    f AS (SELECT c, floor(x) AS q, (SELECT ceil(0.2::DOUBLE * count(*)) FROM embeddings) - sum(floor(x)) OVER () AS rest,
                 row_number() OVER (ORDER BY floor(x) - x, CAST(c AS INTEGER)) AS o FROM e),
    quota AS (SELECT c, q + CASE WHEN o <= rest THEN 1 ELSE 0 END AS q FROM f),
    r AS (SELECT vec_id AS id, CAST(label > 4 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS e,
                 row_number() OVER (PARTITION BY label > 4 ORDER BY vec_id) <= q AS test
          FROM embeddings JOIN quota ON c = (label > 4)),
    d AS (SELECT a.id, b.y, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS k
          FROM r a, r b WHERE a.test AND NOT b.test)
    SELECT id, round(avg(y), 9) AS score, CAST(avg(y) > 0.5 AS INTEGER) AS prediction FROM d WHERE k <= 7 GROUP BY 1""")
def knn_predict(spark, sf):
    df = splits.hold_out(vectors(Tables(spark, sf)), "label", "id", 0.2, seed=None)
    out = neighbors.predict(df.where("is_test"), df.where(~F.col("is_test")))
    return out.select("id", F.round("score", 9).alias("score"), F.col("prediction").cast("int").alias("prediction"))


def _fit_and_measure(name: str):
    def run(spark, sf):
        df = settle(splits.hold_out(vectors(Tables(spark, sf)), "label", "id", 0.2), "vectors")
        model = classifiers.fit(name, df.where(~F.col("is_test")))
        scored = settle(model.predict(df.where("is_test")).select("label", "prediction", "score"), "scored")
        metrics = classification_metrics(scored, "label", "prediction", []).withColumn("k", F.lit(0))
        auc = roc_auc(scored, "label", "score").withColumn("k", F.lit(0))
        return metrics.join(auc, "k").select(F.lit(name).alias("model"), "accuracy", "f1", "roc_auc")
    run.__name__ = f"fit_{name}"
    run.__doc__ = f"Train {name} on the embeddings and measure it on held-out ones."
    return run


for _name in classifiers.MODELS:
    if _name != "knn":
        query()(_fit_and_measure(_name))


# --- the sweep ----------------------------------------------------------------

# Every reducer, clustering and model, at full effort on all training rows.
_SWEEP = SweepConfig(datasets=("embeddings",), n_components=(8,), clustering=("none", "kmeans", "gmm"),
                     models=tuple(classifiers.MODELS), cv_folds=2, sample_rows=0)


def _modelling_table(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("id"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)],
        pick_band(F.get("embedding", F.lit(63))).alias("band"),
        (F.col("label") > 4).cast("int").alias("label"))


def pick_band(c):
    return F.when(c < -0.1, "low").when(c > 0.1, "high").otherwise("middle")


@query()
def cv_leaderboard(spark, sf):
    """Cross-validated grid on the embeddings, with its best cell per dataset refitted and saved."""
    data = {"embeddings": _modelling_table(Tables(spark, sf))}
    board = sweep(spark, data, _SWEEP)
    return lb.sort_leaderboard(board, ties=["reducer", "clustering", "model"])


@query()
def best_refit(spark, sf):
    """Predictions of the saved best pipeline for all rows."""
    data = {"embeddings": _modelling_table(Tables(spark, sf))}
    board = sweep(spark, data, _SWEEP)
    path = refit_best(spark, board, data, _SWEEP)["embeddings"]
    return _apply_best(spark, path, _best_model(board), data["embeddings"]).select(
        "id", F.col("prediction").cast("int").alias("prediction"))


def _best_model(board: DataFrame) -> str:
    """The model refit_best takes."""
    return lb.best_row_per(board, ["dataset"], "test_roc_auc", ["reducer", "clustering", "model", "n_components"]).first()["model"]


def _apply_best(spark, path: str, model: str, df: DataFrame) -> DataFrame:
    """Predictions of a saved best cell; nearest neighbours are saved as vectors, see refit_best."""
    if model != "knn":
        return PipelineModel.load(path).transform(df)
    made = PipelineModel.load(f"{path}/features").transform(df)
    last = next(c for c in ("clustered", "reduced", "features") if c in made.columns)
    near = classifiers.FittedNeighbours(spark.read.parquet(f"{path}/neighbours"), "x", "id")
    return near.predict(made.withColumn("x", F.col(last)))


@query("""
    SELECT status, model, count(*) AS runs, (SELECT count(*) FROM embeddings) AS rows
    FROM (VALUES ('FINISHED', 'logistic_regression'), ('FAILED', 'no_such_model'), ('FINISHED', 'grid_sweep'))
         t(status, model) GROUP BY ALL""")
def run_log(spark, sf):
    """A sweep with one good and one unknown model: the failing cell is logged, the rest go on."""
    data = {"embeddings": _modelling_table(Tables(spark, sf))}
    cfg = SweepConfig(datasets=("embeddings",), reducers=("none",), clustering=("none",),
                      models=("logistic_regression", "no_such_model"), cv_folds=2, sample_rows=0)
    path = scratch_path(spark, "runs")
    sweep(spark, data, cfg, runs_path=path)
    logged = run_tables.read_runs(spark, path)
    n = data["embeddings"].count()
    return (logged.groupBy("status", F.coalesce("model", "name").alias("model"))
            .agg(F.count(F.lit(1)).alias("runs")).withColumn("rows", F.lit(n).cast("long")))


@query()
def model_udf(spark, sf):
    """A saved preprocessing and logistic pipeline, loaded and applied as columns."""
    df = _modelling_table(Tables(spark, sf))
    steps = fit_preprocess(df, [f"e{i}" for i in range(64)], ["band"])
    model = classifiers.fit("logistic_regression", steps.transform(df))
    path = scratch_path(spark, "model")
    PipelineModel([steps, model.model]).save(path)
    out = PipelineModel.load(path).transform(df)
    return out.select("id", F.round(vector_to_array("probability")[1], 6).alias("score"))


# --- prediction targets -------------------------------------------------------

def _ready(table: DataFrame) -> list[str]:
    return [k for k, target in TARGETS.items() if target.scope == "team_game" and not missing_columns(target, table)]


def _train_all(spark, sf, sports: list[str] | None = None, targets: list[str] | None = None,
               parallel: int = 8) -> tuple[DataFrame, str, list[str]]:
    """Train targets on the orders' form with the default rounds: every ready one for every sport, or those named."""
    table = settle(_features(Tables(spark, sf)), "team-games")
    folder = scratch_path(spark, "targets")
    sports = sports or sorted(r["sport"] for r in table.select("sport").where("sport is not null").distinct().collect())

    jobs = [(TARGETS[k], s) for s in sports for k in targets or _ready(table)]
    train_targets(table, jobs, f"{folder}/models", f"{folder}/aliases", f"{folder}/runs", parallel=parallel)
    return table, folder, sports


def _predicted(spark, table: DataFrame, folder: str, sports: list[str]) -> DataFrame:
    scored = reduce(DataFrame.unionByName, [
        score_all(spark, {"team_game_features": table}, s, f"{folder}/aliases", f"{folder}/predictions") for s in sports])
    return scored.select("sport", "scope", "target", "entity_id",
                         F.col("prediction").isNotNull().cast("int").alias("predicted"))


@query()
def team_targets(spark, sf):
    """The run log of all ready targets of all sports with their metrics."""
    _, folder, _ = _train_all(spark, sf)
    logged = run_tables.metric_columns(run_tables.read_runs(spark, f"{folder}/runs"), ["roc_auc", "rmse"])
    return logged.select("name", "status", "dataset", "model", "roc_auc", "rmse")


_EVERY_TARGET = """
    SELECT o_orderstatus AS sport, 'team_game' AS scope, t.target, CAST(o_orderkey AS VARCHAR) AS entity_id,
           1 AS predicted
    FROM orders, (VALUES ('win_probability'), ('points_for'), ('points_against'), ('off_efficiency'),
                         ('def_efficiency')) t(target)"""


@query(_EVERY_TARGET)
def score_targets(spark, sf):
    """Every game of every sport gets a prediction of every ready target, from models of 300 rounds."""
    return _predicted(spark, *_train_all(spark, sf))


@query(_EVERY_TARGET)
def score_every_target(spark, sf):
    """The same as score_targets, under the name it had while that one was narrower."""
    return _predicted(spark, *_train_all(spark, sf))
