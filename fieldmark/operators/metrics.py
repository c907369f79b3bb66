"""Exact model metrics, overall or per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.values import nan_to_null
from fieldmark.operators.ordered import running_sums, values_at_positions
from fieldmark.session import settle


def accuracy(label: str, predicted: str) -> Column:
    return F.avg((F.col(label) == F.col(predicted)).cast("int"))


def f1_positive(label: str, predicted: str) -> Column:
    """F1 of class 1; 0 where neither labels nor predictions hold it."""
    hit = F.count(F.when((F.col(label) == 1) & (F.col(predicted) == 1), 1))
    wrong = F.count(F.when(F.col(label) != F.col(predicted), 1))
    return F.when(2 * hit + wrong > 0, 2 * hit / (2 * hit + wrong)).otherwise(0.0)


def rmse(label: str, predicted: str) -> Column:
    d = F.col(predicted) - F.col(label)
    return F.sqrt(F.avg(d * d))


def classification_metrics(df: DataFrame, label: str, predicted: str,
                           group: list[str] = ()) -> DataFrame:
    return df.groupBy(*group).agg(accuracy(label, predicted).alias("accuracy"),
                                  f1_positive(label, predicted).alias("f1"))


def roc_auc(df: DataFrame, label: str, score: str, group: list[str] = (),
            limit: int | None = None) -> DataFrame:
    """Share of (positive, negative) pairs ordered rightly, ties counted half.

    Scores are counted per distinct value first; NULL where a class is missing.
    """
    group = list(group)
    keys = group or ["__all"]
    if not group:
        df = df.withColumn("__all", F.lit(0))
    df = df.withColumn("__score", nan_to_null(F.col(score).cast("double")))
    per_score = settle(df.where(F.col("__score").isNotNull() & F.col(label).isNotNull())
                       .groupBy(*keys, "__score")
                       .agg(F.count(F.when(F.col(label) == 1, 1)).alias("__pos"),
                            F.count(F.when(F.col(label) != 1, 1)).alias("__neg")), "scores")
    run = running_sums(per_score, keys, ["__score"], {"__neg_upto": "__neg"}, limit)
    pos = F.col("__pos").cast("double")
    wins = F.sum(pos * (F.col("__neg_upto") - F.col("__neg") / 2))
    pairs = F.sum("__pos").cast("double") * F.sum("__neg").cast("double")
    out = run.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))
    return out if group else out.drop("__all")


def latency_percentiles(df: DataFrame, group: list[str], millis: str) -> DataFrame:
    """p50 and p95 picked by index from the sorted times, not interpolated."""
    at = {"latency_ms_p50": F.floor(F.col("n") / 2),
          "latency_ms_p95": F.floor(F.col("n") * F.lit(0.95))}
    out = values_at_positions(df, group, millis, at)
    return out.select(*group, *[F.round(c, 2).alias(c) for c in at])


def group_metrics(df: DataFrame, label: str, predicted: str, score: str,
                  group: list[str]) -> DataFrame:
    """All classification metrics per group, to compare groups of people or sources."""
    counts = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(label).alias("base_rate"),
        accuracy(label, predicted).alias("accuracy"), f1_positive(label, predicted).alias("f1"))
    return counts.join(roc_auc(df, label, score, group), group, "left")


def mean_joint_error(pairs: DataFrame, predicted: list[str], truth: list[str],
                     group: list[str] = ()) -> DataFrame:
    """Mean distance between predicted and true joints."""
    from fieldmark.functions.geometry import joint_distance

    d = joint_distance([F.col(c) for c in predicted], [F.col(c) for c in truth])
    return pairs.groupBy(*group).agg(F.avg(d).alias("mpjpe_mm"))
