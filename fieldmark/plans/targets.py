"""Train one model per prediction target and score all ready targets."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import Lock

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators.boosting import Growth, grow
from fieldmark.operators.metrics import rmse, roc_auc
from fieldmark.operators.preprocess import fit_preprocess
from fieldmark.operators.splits import hold_out
from fieldmark.plans.runs import log_runs, move_alias, resolve, run_record
from fieldmark.registry import KEY_COLUMNS, TARGETS, Target
from fieldmark.session import settle
from fieldmark.sources.sinks import replace_slices

# Alias and run tables are appended to by one training at a time.
_REGISTER = Lock()


def missing_columns(target: Target, table: DataFrame | None) -> list[str]:
    """What the target's feature table lacks; a table that cannot be read lacks itself."""
    if table is None:
        return [f"{target.feature_table} (table)"]
    return sorted({target.label, target.entity} - set(table.columns))


def feature_columns(table: DataFrame, target: Target, strict: bool = False) -> list[str]:
    """Numeric columns that are neither row keys nor labels.

    Labels of the other targets on the same table describe the same game, so they
    are left out; `strict=True` leaves out only the target's own.
    """
    labels = {target.label}
    if not strict:
        labels |= {t.label for t in TARGETS.values() if t.feature_table == target.feature_table}
        labels.add("image_id")
    numeric = {f.name for f in table.schema.fields
               if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    return [c for c in table.columns if c in numeric and c not in KEY_COLUMNS and c not in labels]


def _prepare(table: DataFrame, target: Target, sport: str, key: str | list[str] | None, strict: bool, seed: int):
    """(feature names, rows kept in the shared folder with is_test, fitted preprocessing) of one target."""
    names = feature_columns(table, target, strict)
    key = [key] if isinstance(key, str) else key or [
        c for c in table.columns if c in KEY_COLUMNS | {target.entity, "image_id", "category_id"}]
    rows = (table.where((F.col("sport") == sport) & F.col(target.label).isNotNull())
            .select(*[F.col(c).alias(f"__key{i}") for i, c in enumerate(key)], F.col(target.label).cast("double").alias("label"), *names))
    stratify = "label" if target.kind == "classification" else None
    data = settle(hold_out(rows, stratify, [f"__key{i}" for i in range(len(key))], 0.2, seed), "target")
    return names, data, fit_preprocess(data.where(~F.col("is_test")), names, [], scale=False)


def train_targets(table: DataFrame, jobs: list[tuple[Target, str]], models: str, aliases: str, runs_path: str | None = None,
                  key: str | list[str] | None = None, rounds: int = 300, strict: bool = False, seed: int = 42, parallel: int = 8) -> list[dict]:
    """Fit targets (target, sport) side by side, measure each on a fifth of its rows, save each as `prod`.

    All trees of all targets grow in one fit. `key` names the columns that tell the rows apart
    (if left out: all key columns of the table and image_id, category_id); rows without a label
    are left out.
    """
    spark = table.sparkSession
    names = [f"{sport}_teamperf_{target.key}" for target, sport in jobs]
    with ThreadPoolExecutor(parallel) as pool:
        prepared = list(pool.map(lambda job: _prepare(table, *job, key, strict, seed), jobs))
    train = [steps.transform(data.where(~F.col("is_test"))).select(F.lit(name).alias("problem"), "features", "label")
             for name, (_, data, steps) in zip(names, prepared)]
    kinds = {name: target.kind for name, (target, _) in zip(names, jobs)}
    fitted = grow(reduce(DataFrame.unionByName, train), kinds, Growth(rounds, seed=seed)) if train else {}

    def finish(name: str, job: tuple[Target, str], part) -> dict:
        (target, sport), (features, data, steps) = job, part
        if name not in fitted:
            raise ValueError(f"no rows to train {name}")
        pipeline = PipelineModel([steps, fitted[name]])
        scored = pipeline.transform(data.where("is_test"))
        if target.kind == "classification":
            scored = scored.withColumn("score", vector_to_array("probability")[1])
            value = roc_auc(scored, "label", "score").first()["roc_auc"]
        else:
            value = scored.agg(rmse("label", "prediction").alias("v")).first()["v"]
        with _REGISTER:
            current = resolve(spark, aliases, name)
            path = f"{models}/{name}/v{1 if current is None else current[0] + 1}"
            pipeline.write().overwrite().save(path)
            version = move_alias(spark, aliases, name, path)
            if runs_path:
                log_runs(spark, runs_path, [run_record(
                    f"{sport}_{target.key}", metrics={target.metric: value},
                    params={"sport": sport, "target": target.key, "scope": target.scope,
                            "n_features": len(features)}, tags={"dataset": sport, "model": target.key})])
        return {"target": target.key, "sport": sport,
                target.metric: None if value is None else round(float(value), 4), "model_version": version}

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(finish, names, jobs, prepared))


def train_target(table: DataFrame, target: Target, sport: str, models: str, aliases: str,
                 runs_path: str | None = None, key: str | list[str] | None = None, rounds: int = 300,
                 strict: bool = False, seed: int = 42) -> dict:
    """One target of train_targets."""
    return train_targets(table, [(target, sport)], models, aliases, runs_path, key, rounds, strict, seed)[0]


def score_table(table: DataFrame, target: Target, sport: str, model_path: str) -> DataFrame:
    """Long rows (sport, scope, target, entity_id, prediction, scored_at) of one target."""
    rows = table.where(F.col("sport") == sport)
    scored = PipelineModel.load(model_path).transform(rows)
    return scored.select(
        F.lit(sport).alias("sport"), F.lit(target.scope).alias("scope"),
        F.lit(target.key).alias("target"), F.col(target.entity).cast("string").alias("entity_id"),
        F.col("prediction").cast("double").alias("prediction"),
        F.current_timestamp().alias("scored_at"))


def score_targets(spark: SparkSession, tables: dict[str, DataFrame], sport: str, aliases: str,
                  out: str | None = None) -> DataFrame | None:
    """Score every target that is ready and trained; `out` gets this sport's slice replaced."""
    frames = []
    for target in TARGETS.values():
        table = tables.get(target.feature_table)
        if missing_columns(target, table):
            continue
        model = resolve(spark, aliases, f"{sport}_teamperf_{target.key}")
        if model is None:
            continue
        frames.append(score_table(table, target, sport, model[1]))
    if not frames:
        return None
    scored = reduce(DataFrame.unionByName, frames)
    if out:
        replace_slices(scored, out)
    return scored
