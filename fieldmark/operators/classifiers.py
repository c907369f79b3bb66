"""Registry of classifiers. A fitted one adds `prediction` and `score` (chance of class 1)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.operators import boosting, forests, margins, neighbors, networks
from fieldmark.operators.preprocess import width
from fieldmark.operators.reducers import Projection

MODELS = ["logistic_regression", "svm_rbf", "svm_linear", "knn", "random_forest", "xgboost", "mlp"]


@dataclass(frozen=True)
class Effort:
    """How long training goes on; the defaults are the full settings."""

    linear_iterations: int = 2000
    svm_iterations: int = 1000
    trees: int = 300
    tree_depth: int = 30
    boosting_rounds: int = 300
    network_iterations: int = 800
    fourier_features: int = 512


FULL = Effort()


class Fitted:
    """A trained classifier."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        return out.withColumn("score", vector_to_array("probability")[1])


class FittedNeighbours:
    """k nearest neighbours: the training rows are the model."""

    def __init__(self, train: DataFrame, features: str, key: str, k: int = 7):
        self.train, self.features, self.key, self.k = train, features, key, k

    def predict(self, df: DataFrame) -> DataFrame:
        return neighbors.predict(df, self.train, self.k, self.features, "label", self.key)


def _svm(df: DataFrame, features: str, rows: int, effort: Effort) -> list:
    """Linear SVM and a logistic fit of its margin (Platt 1999).

    One unit of cost per row stands against the penalty, hence 1/rows. Rows that fit a task
    are solved there, which gives the optimum that the iterations approach.
    """
    if rows <= margins.TASK_ROWS:
        return margins.fit_in_task(df, features, effort.svm_iterations)
    return [
        LinearSVC(featuresCol=features, maxIter=effort.svm_iterations, regParam=1.0 / rows,
                  standardization=False, rawPredictionCol="margin"),
        LogisticRegression(featuresCol="margin", predictionCol="calibrated",
                           rawPredictionCol="calibrated_raw"),
    ]


def fourier_features(df: DataFrame, features: str, output: str, count: int, seed: int) -> Projection:
    """Random features of the Gaussian kernel (Rahimi & Recht 2007), width 1/(d * variance)."""
    d = width(df, features)
    s = df.select(Summarizer.metrics("mean", "variance").summary(F.col(features)).alias("s")).first()["s"]
    mean, var = s["mean"].toArray(), s["variance"].toArray()
    spread = float(np.mean(var + mean ** 2) - np.mean(mean) ** 2)
    gamma = 1.0 / (d * spread) if spread > 0 else 1.0
    rng = np.random.default_rng(seed)
    return Projection.of(rng.normal(0.0, np.sqrt(2 * gamma), size=(d, count)), features, output,
                         wave=rng.uniform(0, 2 * np.pi, size=count))


def _released(model):
    """A model without its training summary, which holds the session (and so any observer set on it)."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def _fit_stages(stages: list, df: DataFrame) -> PipelineModel:
    """Like Pipeline.fit, but each model is released before anything transforms with it."""
    fitted = []
    for i, stage in enumerate(stages):
        model = _released(stage.fit(df)) if isinstance(stage, Estimator) else stage
        fitted.append(model)
        if i < len(stages) - 1:
            df = model.transform(df)
    return PipelineModel(fitted)


def fit(name: str, df: DataFrame, features: str = "features", key: str = "id", seed: int = 42,
        effort: Effort = FULL, rows: int | None = None):
    """Train on `features` and a 0/1 `label`.

    With the number of `rows` given, lines and networks whose rows fit a task are solved there,
    in one job instead of one for each step: not to the same decimals as by Spark's learners.
    """
    counted, rows = rows, rows or df.count()
    df = df.withColumn("label", F.col("label").cast("double"))
    if name == "logistic_regression" and counted and rows * width(df, features) <= networks.LINE_CELLS:
        stages = [networks.fit_line(df, features, 1.0 / rows, effort.linear_iterations)]
    elif name == "logistic_regression":
        stages = [LogisticRegression(featuresCol=features, maxIter=effort.linear_iterations,
                                     regParam=1.0 / rows, standardization=False)]
    elif name == "svm_linear":
        stages = _svm(df, features, rows, effort)
    elif name == "svm_rbf":
        waves = fourier_features(df, features, "waves", effort.fourier_features, seed)
        stages = [waves] + _svm(waves.transform(df), "waves", rows, effort)
    elif name == "knn":
        return FittedNeighbours(df, features, key)
    elif name == "random_forest":
        small = rows * width(df, features) <= forests.TASK_CELLS
        grow = forests.fit_in_tasks if rows <= forests.MODEL_ROWS else forests.fit_stored
        stages = [grow(df, features, effort.trees, effort.tree_depth, seed) if small else
                  RandomForestClassifier(featuresCol=features, numTrees=effort.trees, maxDepth=effort.tree_depth, seed=seed)]
    elif name == "xgboost":
        growth = boosting.Growth(effort.boosting_rounds, 4, 0.1, 0.9, 0.9, seed=seed)
        rows = df.select(F.lit(name).alias("problem"), features, "label")
        stages = [boosting.grow(rows, {name: "classification"}, growth, features)[name]]
    elif name == "mlp" and counted and rows <= networks.NETWORK_ROWS:
        stages = [networks.fit_network(df, features, [width(df, features), 64, 32, 2], effort.network_iterations, seed)]
    elif name == "mlp":
        stages = [MultilayerPerceptronClassifier(
            featuresCol=features, layers=[width(df, features), 64, 32, 2],
            maxIter=effort.network_iterations, seed=seed)]
    else:
        raise ValueError(f"unknown model {name!r}; known: {MODELS}")
    return Fitted(_fit_stages(stages, df))

