"""Queries: metrics, leaderboards, run tables, the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.catalog.base import SPORT_NAMES, Tables, pick, query, sql_pick
from fieldmark.functions.values import (cell_name, decode_components, encode_components, nan_to_null)
from fieldmark.operators import leaderboard as lb
from fieldmark.operators import metrics as m
from fieldmark.operators.classifiers import MODELS
from fieldmark.operators.hotkeys import join_unique
from fieldmark.operators.ordered import row_numbers
from fieldmark.operators.reducers import REDUCERS
from fieldmark.plans.comparison import comparison_rows
from fieldmark.plans.grid import SweepConfig, grid_frame
from fieldmark.registry import RUN_METRICS, VISION_MODELS, specs_for

# --- scored cells out of line items -------------------------------------------

_KEYS = ["dataset", "model", "reducer", "clustering"]
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def cells(t: Tables):
    """Line items as scored grid cells; untaxed ones have no score (NaN)."""
    return t.lineitem.select(
        F.col("l_returnflag").alias("dataset"), pick(MODELS, F.col("l_suppkey")).alias("model"),
        pick(REDUCERS, F.col("l_linenumber")).alias("reducer"),
        F.when(F.col("l_linestatus") == "O", "none").otherwise("kmeans").alias("clustering"),
        F.when(F.col("l_tax") == 0, F.lit(float("nan")))
        .otherwise(F.col("l_extendedprice") / 131072).alias("test_roc_auc"),
        F.col("l_discount").alias("test_f1"),
        F.when(F.pmod("l_linenumber", F.lit(4)) == 1, F.col("l_quantity") / 64).alias("pca_explained_var"),
        *_LINE)


_CELLS = f"""
    c AS (SELECT l_returnflag AS dataset, {sql_pick(MODELS, 'l_suppkey')} AS model,
                 {sql_pick(REDUCERS, 'l_linenumber')} AS reducer,
                 CASE WHEN l_linestatus = 'O' THEN 'none' ELSE 'kmeans' END AS clustering,
                 CASE WHEN l_tax <> 0 THEN l_extendedprice / 131072 END AS test_roc_auc,
                 l_discount AS test_f1,
                 CASE WHEN l_linenumber % 4 = 1 THEN l_quantity / 64 END AS pca_explained_var,
                 {', '.join(_LINE)} FROM lineitem)"""


@query(f"WITH {_CELLS} SELECT dataset, model, reducer, max(test_roc_auc) AS test_roc_auc FROM c GROUP BY ALL")
def leaderboard_best(spark, sf):
    return lb.best_per(cells(Tables(spark, sf)), ["dataset", "model", "reducer"], "test_roc_auc")


@query(f"WITH {_CELLS} SELECT dataset, model, " + ", ".join(
    f"round(max(test_roc_auc) FILTER (WHERE reducer = '{r}'), 3) AS {r}" for r in REDUCERS)
    + " FROM c GROUP BY ALL")
def leaderboard_pivot(spark, sf):
    return lb.pivot_best(cells(Tables(spark, sf)), ["dataset", "model"], "reducer", REDUCERS, "test_roc_auc")


@query(f"""WITH {_CELLS}
    SELECT dataset, model, reducer, clustering, test_roc_auc, test_f1 FROM c
    ORDER BY test_roc_auc DESC NULLS LAST, {', '.join(_LINE)} LIMIT 10""")
def leaderboard_top10(spark, sf):
    columns = ["dataset", "model", "reducer", "clustering", "test_roc_auc", "test_f1"]
    return lb.top_cells(cells(Tables(spark, sf)), "test_roc_auc", columns, ties=_LINE)


@query(f"""WITH {_CELLS}
    SELECT dataset, model, reducer, clustering, test_roc_auc, l_orderkey FROM c
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY test_roc_auc DESC NULLS LAST, {', '.join(_LINE)}) = 1""")
def best_per_dataset(spark, sf):
    best = lb.best_row_per(cells(Tables(spark, sf)), ["dataset"], "test_roc_auc", _LINE)
    return best.select("dataset", "model", "reducer", "clustering", "test_roc_auc", "l_orderkey")


@query(f"""WITH {_CELLS},
    b AS (SELECT dataset, model, reducer, max(test_roc_auc) AS s FROM c GROUP BY ALL)
    SELECT b.dataset, b.model, b.reducer, b.s - n.s AS lift
    FROM b LEFT JOIN b n ON n.dataset = b.dataset AND n.model = b.model AND n.reducer = 'none'
    WHERE b.reducer <> 'none'""")
def reducer_lift(spark, sf):
    return lb.lift_over(cells(Tables(spark, sf)), ["dataset", "model"], "reducer", "none",
                        "test_roc_auc", "lift")


@query(f"""WITH {_CELLS}
    SELECT dataset, model, reducer,
           max(test_roc_auc) FILTER (WHERE clustering = 'kmeans')
           - max(test_roc_auc) FILTER (WHERE clustering = 'none') AS lift FROM c GROUP BY ALL""")
def cluster_lift(spark, sf):
    return lb.lift_between(cells(Tables(spark, sf)), ["dataset", "model", "reducer"], "clustering",
                           "kmeans", "none", "test_roc_auc", "lift")


@query(f"""WITH {_CELLS}
    SELECT dataset, round(corr(pca_explained_var, test_roc_auc), 6) AS r, count(*) AS cells
    FROM c WHERE reducer = 'pca' AND test_roc_auc IS NOT NULL GROUP BY ALL""")
def explained_var_corr(spark, sf):
    df = cells(Tables(spark, sf)).withColumn("test_roc_auc", nan_to_null(F.col("test_roc_auc")))
    return (df.where((F.col("reducer") == "pca") & F.col("test_roc_auc").isNotNull())
            .groupBy("dataset").agg(F.round(F.corr("pca_explained_var", "test_roc_auc"), 6).alias("r"),
                                    F.count(F.lit(1)).alias("cells")))


@query(f"""WITH {_CELLS}
    SELECT {', '.join(_KEYS)}, round(avg(test_roc_auc), 6) AS cv_roc_auc, round(avg(test_f1), 6) AS cv_f1
    FROM c GROUP BY ALL""")
def fold_means(spark, sf):
    df = cells(Tables(spark, sf))
    return df.groupBy(*_KEYS).agg(
        F.round(F.avg(nan_to_null(F.col("test_roc_auc"))), 6).alias("cv_roc_auc"),
        F.round(F.avg("test_f1"), 6).alias("cv_f1"))


@query(f"""WITH {_CELLS} SELECT {', '.join(_LINE)}, test_roc_auc,
           cast(test_roc_auc > 0.4 AS INTEGER) AS good FROM c""")
def metric_nulls(spark, sf):
    """NaN would count as larger than 0.4; as NULL it does not."""
    clean = nan_to_null(F.col("test_roc_auc"))
    return cells(Tables(spark, sf)).select(*_LINE, clean.alias("test_roc_auc"),
                                           (clean > 0.4).cast("int").alias("good"))


@query(f"""WITH {_CELLS} SELECT {', '.join(_LINE)}, test_f1 FROM c
           WHERE dataset = 'R' AND reducer = 'pca' AND model = 'knn'""")
def run_search(spark, sf):
    found = lb.search_runs(cells(Tables(spark, sf)), dataset="R", reducer="pca", model="knn")
    return found.select(*_LINE, "test_f1")


@query(f"""WITH {_CELLS}
    SELECT dataset, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (
        PARTITION BY dataset ORDER BY test_roc_auc DESC NULLS LAST, {', '.join(_LINE)}) AS place FROM c""")
def leaderboard_sorted(spark, sf):
    """The place of every cell in its dataset's leaderboard.

    Three datasets hold all rows, so the ranking is one that can split a dataset.
    """
    down = F.coalesce(-nan_to_null(F.col("test_roc_auc")), F.lit(float("inf")))
    df = cells(Tables(spark, sf)).select("dataset", down.alias("down"), *_LINE)
    return row_numbers(df, ["dataset"], ["down", *_LINE], "place").drop("down")


@query(f"""WITH {_CELLS}
    SELECT dataset || '|' || reducer || '|k' || CASE WHEN reducer = 'none' THEN -1 ELSE 10 END || '|'
           || clustering || '|' || model AS name, count(*) AS n FROM c GROUP BY 1""")
def cell_names(spark, sf):
    k = encode_components(F.when(F.col("reducer") != "none", F.lit(10)))
    name = cell_name(F.col("dataset"), F.col("reducer"), k, F.col("clustering"), F.col("model"))
    return cells(Tables(spark, sf)).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CELLS}, k AS (SELECT *, CASE WHEN reducer <> 'none' THEN l_linenumber END AS k FROM c)
    SELECT {', '.join(_LINE)}, coalesce(k, -1) AS stored, k AS restored,
           'golf' AS sport, 'team_game' AS scope FROM k""")
def component_codes(spark, sf):
    stored = encode_components(F.when(F.col("reducer") != "none", F.col("l_linenumber")))
    return (cells(Tables(spark, sf)).withColumn("stored", stored)
            .select(*_LINE, "stored", decode_components(F.col("stored")).alias("restored"),
                    F.lit("golf").alias("sport"), F.lit("team_game").alias("scope")))


# --- events as model runs -----------------------------------------------------

_MODEL_KEYS = list(VISION_MODELS)


def runs(t: Tables):
    """Events as runs; every user trains one model of one sport, some runs do not finish."""
    sport = pick(SPORT_NAMES, F.col("user_id"))
    model = pick(_MODEL_KEYS, F.floor(F.col("user_id") / 6))
    return t.events.select(
        F.col("event_id").alias("run_id"), F.concat_ws("_", sport, model).alias("name"),
        F.when(F.col("event_type").isin("purchase", "view", "click"), "FINISHED")
        .otherwise("FAILED").alias("status"),
        F.col("ts").alias("start_time"),
        F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value"))
        .alias("detect_map"),
        (F.col("value") / 2).alias("latency_ms_p50"))


_RUNS = f"""
    r AS (SELECT event_id AS run_id, {sql_pick(SPORT_NAMES, 'user_id')} AS sport,
                 {sql_pick(_MODEL_KEYS, '(user_id // 6)')} AS model_key, ts,
                 event_type IN ('purchase', 'view', 'click') AS finished,
                 CASE WHEN event_type <> 'click' THEN value END AS detect_map, value / 2 AS latency
          FROM events),
    f AS (SELECT * FROM r WHERE finished
          QUALIFY row_number() OVER (PARTITION BY sport, model_key ORDER BY ts DESC, run_id DESC) = 1)"""


@query(f"""WITH {_RUNS}
    SELECT sport || '_' || model_key AS name, run_id, detect_map FROM f""")
def latest_run(spark, sf):
    newest = lb.latest_finished(runs(Tables(spark, sf)), ["name"])
    return newest.select("name", "run_id", nan_to_null(F.col("detect_map")).alias("detect_map"))


@query("SELECT event_id AS run_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def newest_run(spark, sf):
    return (runs(Tables(spark, sf)).orderBy(F.desc("start_time"), F.desc("run_id")).limit(1)
            .select("run_id"))


_MODEL_ROWS = ", ".join(f"('{v.key}', '{v.family}', '{v.task}', '{v.description}')"
                        for v in VISION_MODELS.values())


@query(f"""WITH {_RUNS}, m(model_key, family, task, description) AS (VALUES {_MODEL_ROWS})
    SELECT sport, m.model_key, family, task, description, CAST(run_id AS VARCHAR) AS run_id,
           {', '.join('detect_map' if c == 'detect_map' else 'latency AS latency_ms_p50'
                      if c == 'latency_ms_p50' else f'CAST(NULL AS DOUBLE) AS {c}' for c in RUN_METRICS)}
    FROM f JOIN m ON m.model_key = f.model_key""")
def model_comparison(spark, sf):
    return comparison_rows(spark, runs(Tables(spark, sf)), SPORT_NAMES)


@query(f"""WITH {_RUNS}, m(model_key, family, task, description) AS (VALUES {_MODEL_ROWS}),
    b AS (SELECT sport, m.model_key, task, detect_map FROM f JOIN m ON m.model_key = f.model_key)
    SELECT sport, model_key, CAST(row_number() OVER (ORDER BY task DESC, detect_map DESC NULLS LAST, sport, model_key)
                                  AS INTEGER) AS place,
           CAST(row_number() OVER (PARTITION BY sport ORDER BY task, detect_map DESC NULLS LAST, model_key)
                AS INTEGER) AS place_in_sport FROM b""")
def comparison_sorted(spark, sf):
    """Places in the comparison, in both orders it is shown in.

    The table has one row per sport and registered model, so few that its sorted
    rows may be numbered on the driver.
    """
    board = comparison_rows(spark, runs(Tables(spark, sf)), SPORT_NAMES).select(
        "sport", "model_key", "task", "pose_map", "detect_map")
    ties = ["sport", "model_key"]
    overall = [(r["sport"], r["model_key"]) for r in lb.sort_comparison(board, ties=ties).collect()]
    seen, rows = {}, []
    for r in lb.sort_comparison(board, by_sport=True, ties=ties).collect():
        seen[r["sport"]] = seen.get(r["sport"], 0) + 1
        key = (r["sport"], r["model_key"])
        rows.append((*key, overall.index(key) + 1, seen[r["sport"]]))
    return spark.createDataFrame(rows, "sport string, model_key string, place int, place_in_sport int")


@query(f"""WITH {_RUNS}, m(model_key, family, task, description) AS (VALUES {_MODEL_ROWS})
    SELECT m.model_key, family, count(*) AS runs, round(avg(latency), 6) AS latency
    FROM r JOIN m ON m.model_key = r.model_key WHERE task = 'pose' GROUP BY ALL""")
def registry_filter(spark, sf):
    """Runs of the registered pose models."""
    pose = spark.createDataFrame([(s.key, s.family) for s in specs_for(task="pose")],
                                 "model_key string, family string")
    model = pick(_MODEL_KEYS, F.floor(F.col("user_id") / 6))
    events = Tables(spark, sf).events.select(model.alias("model_key"), "value")
    return (events.join(F.broadcast(pose), "model_key").groupBy("model_key", "family")
            .agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(F.col("value") / 2), 6).alias("latency")))


_GRID = SweepConfig(n_components=(5, 8, 5))


@query(f"""
    SELECT d.dataset, r.reducer, r.n_components, c.clustering, m.model
    FROM (SELECT DISTINCT source AS dataset FROM documents) d,
         (VALUES ('none', CAST(NULL AS INTEGER)), {', '.join(f"('{r}', {k})" for r in REDUCERS[1:] for k in (5, 8))})
             r(reducer, n_components),
         (VALUES ('none'), ('kmeans')) c(clustering),
         (VALUES {', '.join(f"('{v}')" for v in _GRID.models)}) m(model)""")
def expand_grid(spark, sf):
    """The grid over all document sources; a repeated component count adds no cell."""
    return grid_frame(Tables(spark, sf).documents.select(F.col("source").alias("dataset")), _GRID)


@query("SELECT DISTINCT source AS dataset, lang FROM documents")
def distinct_keys(spark, sf):
    return Tables(spark, sf).documents.select(F.col("source").alias("dataset"), "lang").distinct()


# --- metrics ------------------------------------------------------------------

def judged(t: Tables):
    """Judged documents; their length is the score, long ones are predicted to be good."""
    both = join_unique(t.labels, t.documents.select("doc_id", "n_chars", "lang"), ["doc_id"], "inner")
    return both.withColumn("predicted", (F.col("n_chars") >= 1500).cast("int"))


_JUDGED = """
    j AS (SELECT l.doc_id, quality, toxic, lang, n_chars, CAST(n_chars >= 1500 AS INTEGER) AS predicted
          FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
_ACC = "round(avg(CAST(quality = predicted AS INTEGER)), 9)"
_F1 = """round(coalesce(2.0::DOUBLE * sum(quality * predicted) / nullif(sum(quality) + sum(predicted), 0), 0), 9)"""
_AUC = """(SELECT round(avg(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5
                       ELSE 0.0 END), 9)
           FROM j p, j n WHERE p.quality = 1 AND n.quality = 0{more})"""


@query(f"WITH {_JUDGED} SELECT {_ACC} AS accuracy, {_F1} AS f1 FROM j")
def accuracy_f1(spark, sf):
    out = m.classification_metrics(judged(Tables(spark, sf)), "quality", "predicted")
    return out.select(F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1"))


@query(f"WITH {_JUDGED} SELECT {_AUC.format(more='')} AS roc_auc")
def roc_auc_exact(spark, sf):
    return m.roc_auc(judged(Tables(spark, sf)), "quality", "n_chars").select(
        F.round("roc_auc", 9).alias("roc_auc"))


@query(f"""WITH {_JUDGED}
    SELECT lang, count(*) AS rows, round(avg(quality), 9) AS base_rate, {_ACC} AS accuracy, {_F1} AS f1,
           {_AUC.format(more=' AND p.lang = g.lang AND n.lang = g.lang')} AS roc_auc
    FROM j g GROUP BY lang""")
def group_metrics(spark, sf):
    out = m.group_metrics(judged(Tables(spark, sf)), "quality", "predicted", "n_chars", ["lang"])
    return out.select("lang", "rows", *[F.round(c, 9).alias(c)
                                        for c in ("base_rate", "accuracy", "f1", "roc_auc")])


@query("""SELECT l_returnflag, round(sqrt(avg((l_quantity * 1500 - l_extendedprice) ** 2)), 4) AS rmse
          FROM lineitem GROUP BY 1""")
def rmse(spark, sf):
    df = Tables(spark, sf).lineitem.withColumn("predicted", F.col("l_quantity") * 1500)
    return df.groupBy("l_returnflag").agg(F.round(m.rmse("l_extendedprice", "predicted"), 4).alias("rmse"))


@query("""
    WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, round(v[n // 2 + 1], 2) AS latency_ms_p50,
           round(v[CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1], 2) AS latency_ms_p95 FROM s""")
def latency_percentiles(spark, sf):
    return m.latency_percentiles(Tables(spark, sf).events, ["event_type"], "value")
