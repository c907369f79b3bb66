"""Networks and logistic lines over rows that fit one task: all steps in one job.

Both minimise what Spark's learners minimise, with the same start, limits and stops; those run
a job for each step. The network is MultilayerPerceptronClassifier's: sigmoid layers and a softmax,
the mean cross entropy (of all rows; Spark's is the mean over blocks of rows), L-BFGS with ten corrections (Liu and Nocedal 1989) and a strong Wolfe search
(Nocedal and Wright 2006). The line is LogisticRegression's without standardisation: the mean log
loss plus half the squared weights times the penalty, solved by damped Newton steps to the optimum
that L-BFGS approaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.ml.common import _java2py, _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NETWORK_ROWS = 16_384       # rows whose steps run in one task
LINE_CELLS = 16_000_000     # rows times columns that a task may hold
_TOLERANCE, _KEPT, _PAST = 1e-6, 10, 20     # Spark's tolerance; corrections and values that L-BFGS keeps


def _loss_of(x: np.ndarray, label: np.ndarray, layers: list[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean cross entropy and its gradient as a function of all weights: of each layer inputs x outputs, then the offsets."""
    truth = np.eye(layers[-1])[label.astype(int)]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        at, parts, values = 0, [], [x]
        for inputs, outputs in zip(layers, layers[1:]):
            matrix, offset = w[at:at + inputs * outputs].reshape(inputs, outputs), w[at + inputs * outputs:at + (inputs + 1) * outputs]
            at += (inputs + 1) * outputs
            parts.append(matrix)
            z = values[-1] @ matrix + offset
            values.append(1 / (1 + np.exp(-np.clip(z, -500, 500))) if len(parts) < len(layers) - 1 else z)
        z = values.pop()
        z = z - z.max(axis=1, keepdims=True)
        logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        error, slopes = (np.exp(logs) - truth) / len(x), []
        for matrix, value in zip(parts[::-1], values[::-1]):
            slopes += [error.sum(axis=0), (value.T @ error).ravel()]
            if value is not x:
                error = (error @ matrix.T) * value * (1 - value)
        return float(-(truth * logs).sum() / len(x)), np.concatenate(slopes[::-1])

    return loss


def _wolfe(along: Callable[[float], tuple[float, float]], value: float, slope: float, step: float) -> float:
    """A step that fulfils the strong Wolfe conditions, or the best one found in some tries."""
    low, high = (0.0, value, slope), None
    for _ in range(20):
        f, d = along(step)
        if not np.isfinite(f) or f > value + 1e-4 * step * slope or f >= low[1] and low[0] > 0:
            high = step, f, d
        elif abs(d) <= -0.9 * slope:
            return step
        elif d * ((high[0] if high else np.inf) - low[0]) >= 0:
            low, high = (step, f, d), low
        else:
            low = step, f, d
        if high is None:
            step *= 2
            continue
        # The least point of the cubic through both ends, not too near to either.
        (a, fa, da), (b, fb, db) = low, high
        middle = (a + b) / 2
        if np.isfinite(fb) and a != b:
            e = da + db - 3 * (fa - fb) / (a - b)
            root = e * e - da * db
            if root >= 0:
                root = np.sign(b - a) * np.sqrt(root)
                if db - da + 2 * root:
                    middle = b - (b - a) * (db + root - e) / (db - da + 2 * root)
        near, far = sorted((a + 0.1 * (b - a), b - 0.1 * (b - a)))
        step = min(max(middle, near), far) if np.isfinite(middle) else (a + b) / 2
    return low[0]


def descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS from `w`, until the loss or its slope settles or after some steps."""
    value, slope = loss(w)
    scale, past, kept = abs(value), [np.inf], []
    for step in range(steps):
        if np.linalg.norm(slope) <= max(_TOLERANCE * abs(value), 1e-8):
            break
        way, shares = slope.copy(), []
        for s, y, r in reversed(kept):
            shares.append(r * (s @ way))
            way -= shares[-1] * y
        if kept:
            s, y, r = kept[-1]
            way /= r * (y @ y)
        for (s, y, r), a in zip(kept, reversed(shares)):
            way += s * (a - r * (y @ way))
        way, found = -way, {}

        def along(t: float, w=w, way=way, found=found) -> tuple[float, float]:
            found[t] = loss(w + t * way)
            return found[t][0], float(found[t][1] @ way)

        drop = float(slope @ way)
        length = _wolfe(along, value, drop, 1.0 if step else 1 / np.linalg.norm(way)) if drop < 0 else 0.0
        if not length:
            if not kept:
                break
            kept = []                       # start again along the slope
            continue
        new, new_slope = found[length]
        change = length * way, new_slope - slope
        if change[0] @ change[1] > 0:
            kept = [*kept, (*change, 1 / (change[0] @ change[1]))][-_KEPT:]
        w, value, slope = w + length * way, new, new_slope
        past = [*past, value][-_PAST:]
        if abs(value - max(past)) <= _TOLERANCE * scale:
            break
    return w


def solve_line(x: np.ndarray, label: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Weights and, last, the intercept of the penalised logistic line."""
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], penalty), 0.0)

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(np.mean(np.logaddexp(0.0, z) - label * z) + (ridge * v * v).sum() / 2)

    at = np.zeros(a.shape[1])
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(a @ at, -500, 500)))
        slope = a.T @ (chance - label) / len(x) + ridge * at
        if np.abs(slope).max() < 1e-10:
            break
        curve = (a * (chance * (1 - chance))[:, None]).T @ a / len(x) + np.diag(ridge + 1e-12)
        step, size, now = np.linalg.solve(curve, slope), 1.0, loss(at)
        while size > 1e-9 and not loss(at - size * step) < now:
            size /= 2
        if size <= 1e-9:
            break
        at = at - size * step
    return at


def _in_task(df: DataFrame, features: str, solve: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """solve(rows, labels) in one task, whatever the order in which rows arrive; like Spark's learners not with missing values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.stack(b.column(0).to_numpy(zero_copy_only=False)), b.column(1).to_numpy(zero_copy_only=False))
                 for b in batches if b.num_rows]
        x, label = (np.concatenate(c) for c in zip(*parts))
        if not (np.isfinite(label).all() and np.isfinite(x).all()):
            raise ValueError("labels and features must not be NULL, NaN or infinite")
        order = np.lexsort([label, *x.T[::-1]])
        yield pa.RecordBatch.from_arrays([pa.array([solve(x[order], label[order]).tolist()], pa.list_(pa.float64()))], ["w"])

    rows = df.select(vector_to_array(features).alias("x"), F.col("label").cast("double").alias("label"))
    return np.array(rows.coalesce(1).mapInArrow(run, "w array<double>").first()["w"])


def fit_network(df: DataFrame, features: str, layers: list[int], steps: int, seed: int) -> MultilayerPerceptronClassificationModel:
    """Spark's network of the layers, from the weights that its learner starts with."""
    context = df.sparkSession.sparkContext
    sizes = context._gateway.new_array(context._jvm.int, len(layers))
    for i, size in enumerate(layers):
        sizes[i] = size
    topology = context._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(sizes, True)
    start = _java2py(context, topology.model(seed).weights()).toArray()
    found = _in_task(df, features, lambda x, label: descend(_loss_of(x, label, layers), start, steps))
    model = context._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(
        "network", _py2java(context, Vectors.dense(found)))
    model.set(model.layers(), sizes)
    return MultilayerPerceptronClassificationModel(model).setFeaturesCol(features)


def fit_line(df: DataFrame, features: str, penalty: float, steps: int) -> LogisticRegressionModel:
    found = _in_task(df, features, lambda x, label: solve_line(x, label, penalty, steps))
    context = df.sparkSession.sparkContext
    model = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "line", _py2java(context, Vectors.dense(found[:-1])), float(found[-1]))
    return LogisticRegressionModel(model).setFeaturesCol(features)
