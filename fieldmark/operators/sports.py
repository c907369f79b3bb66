"""Aggregations driven by the sport registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.registry import classes_frame, sports_frame


def name_classes(df: DataFrame) -> DataFrame:
    """Attach the class name of (sport, category_id); NULL where the sport has no such class."""
    return df.join(F.broadcast(classes_frame(df.sparkSession)), ["sport", "category_id"], "left")


def team_scores(df: DataFrame, points: str) -> DataFrame:
    """Team score per game in the unit of its sport."""
    scores = df.groupBy("sport", "team", "game_id").agg(F.sum(points).alias("score"))
    return scores.join(F.broadcast(sports_frame(df.sparkSession)), "sport", "left")


def event_counts(df: DataFrame, entity: list[str], event: str, names: list[str]) -> DataFrame:
    """One count column per named event; the names are given, so no extra job finds them."""
    counted = df.groupBy(*entity).pivot(event, list(names)).agg(F.count(F.lit(1)))
    return counted.na.fill(0, list(names))
