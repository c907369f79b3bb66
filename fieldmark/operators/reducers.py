"""Dimension reduction: principal, independent and random components."""

from __future__ import annotations

import pickle
from threading import Lock

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.operators.preprocess import width
from fieldmark.session import settle

# The JVM's own eigenvalue routines keep state between calls and must not run
# side by side in one driver.
EIGEN_LOCK = Lock()

TASK_CELLS = 16_000_000  # rows times columns that one task may hold as doubles

REDUCERS = ["none", "pca", "ica", "random_projection"]


class Projection(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                 DefaultParamsWritable):
    """(x - shift) times a small matrix; with `wave`, sqrt(2/k) cos(. + wave).

    The matrix has (columns of the data) x (components) entries, whatever the rows.
    """

    weights = Param(Params._dummy(), "weights", "matrix, row after row",
                    TypeConverters.toListFloat)
    components = Param(Params._dummy(), "components", "output width", TypeConverters.toInt)
    shift = Param(Params._dummy(), "shift", "subtracted first", TypeConverters.toListFloat)
    wave = Param(Params._dummy(), "wave", "phases of a cosine", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, weights=None, components=None,
                 shift=None, wave=None):
        super().__init__()
        self._setDefault(shift=[], wave=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(matrix: np.ndarray, input_col: str, output_col: str, shift=None, wave=None) -> Projection:
        return Projection(inputCol=input_col, outputCol=output_col,
                          weights=matrix.ravel().tolist(), components=int(matrix.shape[1]),
                          shift=[] if shift is None else [float(v) for v in shift],
                          wave=[] if wave is None else [float(v) for v in wave])

    def matrix(self) -> np.ndarray:
        return np.array(self.getOrDefault(self.weights)).reshape(
            -1, self.getOrDefault(self.components))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        matrix = self.matrix()
        shift = np.array(self.getOrDefault(self.shift) or 0.0)
        wave = np.array(self.getOrDefault(self.wave))
        scale = np.sqrt(2.0 / matrix.shape[1])

        @F.pandas_udf("array<double>")
        def project(rows: pd.Series) -> pd.Series:
            if rows.empty:
                return pd.Series([], dtype=object)
            out = (np.stack(rows.to_numpy()) - shift) @ matrix
            if wave.size:
                out = scale * np.cos(out + wave)
            return pd.Series(list(out))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(
            project(vector_to_array(self.getInputCol()))))


def moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sample covariance of a vector column.

    The sums are built in the JVM and reduced as a tree; what arrives here is
    columns x columns, whatever the number of rows.
    """
    row = df.select(Summarizer.metrics("count", "mean", "std").summary(F.col(column)).alias("s")).first()["s"]
    std = row["std"].toArray()
    corr = Correlation.corr(df, column).first()[0].toArray()
    cov = np.nan_to_num(corr, nan=0.0) * np.outer(std, std)
    np.fill_diagonal(cov, std ** 2)
    return row["count"], row["mean"].toArray(), cov


def covariance_rows(df: DataFrame, column: str) -> DataFrame:
    """The covariance matrix as rows (i, j, cov)."""
    _, _, cov = moments(df, column)
    d = len(cov)
    return df.sparkSession.createDataFrame(
        [(i, j, float(cov[i, j])) for i in range(d) for j in range(d)], "i int, j int, cov double")


def clamp_components(k: int | None, columns: int) -> int:
    return max(1, min(columns if k is None else int(k), columns))


def fit_pca(df: DataFrame, k: int | None, input_col: str, output_col: str) -> PipelineModel:
    """Centred principal components; pyspark's own projection does not centre."""
    k = clamp_components(k, width(df, input_col))
    center = StandardScaler(inputCol=input_col, outputCol=f"{output_col}__centred",
                            withMean=True, withStd=False).fit(df)
    with EIGEN_LOCK:
        pca = PCA(k=k, inputCol=f"{output_col}__centred", outputCol=output_col).fit(
            center.transform(df))
    return PipelineModel([center, pca])


def explained_variance(model: PipelineModel) -> list[float] | None:
    """Shares of variance of a fitted PCA, None for other reducers."""
    last = model.stages[-1]
    return [float(v) for v in last.explainedVariance] if hasattr(last, "explainedVariance") else None


def loadings(model: PipelineModel, names: list[str], spark) -> DataFrame:
    """(component, feature, loading) of a fitted PCA."""
    pc = model.stages[-1].pc.toArray()
    return spark.createDataFrame(
        [(c, names[f], float(pc[f, c])) for c in range(pc.shape[1]) for f in range(pc.shape[0])],
        "component int, feature string, loading double")


def heaviest(loading_rows: DataFrame, n: int = 10) -> DataFrame:
    """The n features with the largest absolute loading per component."""
    w = Window.partitionBy("component").orderBy(F.abs("loading").desc(), F.asc("feature"))
    return (loading_rows.withColumn("position", F.row_number().over(w))
            .where(F.col("position") <= n))


def fit_random_projection(df: DataFrame, k: int | None, input_col: str, output_col: str,
                          seed: int = 42) -> PipelineModel:
    d = width(df, input_col)
    return PipelineModel([Projection.of(random_matrix(d, clamp_components(k, d), seed),
                                        input_col, output_col)])


def random_matrix(d: int, k: int, seed: int) -> np.ndarray:
    """Entries N(0, 1/k), the same for the same seed."""
    return np.random.default_rng(seed).normal(0.0, 1.0 / np.sqrt(k), size=(d, k))


def fit_ica(df: DataFrame, k: int | None, input_col: str, output_col: str, seed: int = 42,
            max_iter: int = 1000, tol: float = 1e-3) -> PipelineModel:
    """Independent components (FastICA, Hyvarinen 1999): symmetric, tanh, unit variance.

    The data is whitened to k columns once and kept. Rows that fit a task are iterated there;
    of more rows, every round sums k x k numbers per partition, so it reads rows x k values and
    moves next to nothing.
    Components come out by falling |excess kurtosis|, the largest weight positive.
    """
    n, mean, cov = moments(df, input_col)
    k = clamp_components(k, len(mean))
    values, vectors = np.linalg.eigh(cov * (n - 1) / n)
    top = np.argsort(values)[::-1][:k]
    top = top[values[top] > 1e-12 * max(values[top[0]], 0.0)]   # relative: units do not matter
    k = len(top)
    whiten = vectors[:, top] / np.sqrt(values[top])            # d x k
    white = settle(Projection.of(whiten, input_col, "z", shift=mean).transform(df)
                   .select(vector_to_array("z").alias("z")), "white")

    def rounds(sums) -> tuple[np.ndarray, np.ndarray]:
        w = _decorrelate(np.random.default_rng(seed).normal(size=(k, k)))
        for _ in range(max_iter):
            gz, slope = _round_sums(sums, w)
            new = _decorrelate(gz / n - (slope / n)[:, None] * w)
            change = np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1))
            w = new
            if change < tol:
                break
        return w, sums(k, lambda z: ((z @ w.T) ** 4).sum(axis=0))

    w, fourth = iterate(white, n * k, rounds)
    unmix = whiten @ w.T                                       # d x k
    unmix = unmix[:, np.argsort(-np.abs(fourth / n - 3.0))]
    signs = np.sign(unmix[np.argmax(np.abs(unmix), axis=0), range(k)])
    return PipelineModel([Projection.of(unmix * signs, input_col, output_col, shift=mean)])


def _decorrelate(w: np.ndarray) -> np.ndarray:
    s, u = np.linalg.eigh(w @ w.T)
    return u @ np.diag(1.0 / np.sqrt(np.maximum(s, 1e-300))) @ u.T @ w


def _partial_sums(white: DataFrame, size: int, block) -> np.ndarray:
    """Add up block(matrix of rows) over all rows: one small array per partition."""
    def per_partition(batches):
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += block(np.stack(pdf["z"].to_numpy()))
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    rows = (white.mapInPandas(per_partition, "i int, v double")
            .groupBy("i").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def iterate(data: DataFrame, cells: int, rounds, task_cells: int | None = None):
    """rounds(sums) for an iteration that only needs sums(size, block) over the rows of the column `z`.

    `cells`, rows times columns, decides where: up to TASK_CELLS all rounds run in one task that holds
    the rows; beyond that each sum is a job that moves one small array per partition.
    """
    if cells > (TASK_CELLS if task_cells is None else task_cells):
        data = data.persist(StorageLevel.MEMORY_AND_DISK)      # read once per round
        try:
            return rounds(lambda size, block: _partial_sums(data, size, block))
        finally:
            data.unpersist()

    def run(batches):
        kept = [np.stack(pdf["z"].to_numpy()) for pdf in batches if len(pdf)]
        z = np.concatenate(kept) if kept else None
        out = rounds(lambda size, block: np.zeros(size) if z is None else block(z))
        yield pd.DataFrame({"out": [pickle.dumps(out)]})

    return pickle.loads(data.coalesce(1).mapInPandas(run, "out binary").first()["out"])


def _round_sums(sums, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = len(w)

    def block(z: np.ndarray) -> np.ndarray:
        g = np.tanh(z @ w.T)
        return np.concatenate([(g.T @ z).ravel(), (1.0 - g * g).sum(axis=0)])

    found = sums(k * k + k, block)
    return found[:k * k].reshape(k, k), found[k * k:]


def fit_reducer(kind: str, df: DataFrame, k: int | None, input_col: str, output_col: str,
                seed: int = 42) -> PipelineModel | None:
    """A fitted reducer; None for `none`, where the step is left out."""
    if kind in (None, "none"):
        return None
    if kind == "pca":
        return fit_pca(df, k, input_col, output_col)
    if kind == "ica":
        return fit_ica(df, k, input_col, output_col, seed)
    if kind == "random_projection":
        return fit_random_projection(df, k, input_col, output_col, seed)
    raise ValueError(f"unknown reducer {kind!r}; known: {REDUCERS}")
