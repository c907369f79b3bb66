"""The refinement layers as DataFrame -> DataFrame functions, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.geometry import (angle_triples, box_area, sport_angles, triple_angle,
                                          visible_points)
from fieldmark.functions.values import LABEL_SPLIT, LABEL_SPORT, path_key, to_number
from fieldmark.operators.hotkeys import join_unique
from fieldmark.operators.ordered import find_segments, rolling_previous
from fieldmark.operators.quality import GAME_RULES, IMAGE_RULES, KEYPOINT_RULES


# --- bronze: flat, typed, unfiltered ------------------------------------------

def bronze_images(labels: DataFrame) -> DataFrame:
    return labels.select(F.explode("images").alias("i"), "source_file").select(
        F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height",
        path_key(F.col("source_file"), LABEL_SPORT).alias("sport"),
        path_key(F.col("source_file"), LABEL_SPLIT).alias("split"))


def bronze_keypoints(labels: DataFrame, with_split: bool = False) -> DataFrame:
    """One instance per row. `with_split` also carries the split of its file."""
    bbox = F.col("a.bbox")
    split = [path_key(F.col("source_file"), LABEL_SPLIT).alias("split")] if with_split else []
    return labels.select(F.explode("annotations").alias("a"), "source_file").select(
        "a.image_id", "a.category_id", bbox.alias("bbox"), box_area(bbox).alias("bbox_area"),
        "a.keypoints",
        F.coalesce("a.num_keypoints", F.lit(0)).alias("num_visible_keypoints"),
        path_key(F.col("source_file"), LABEL_SPORT).alias("sport"), *split)


def bronze_games(games: DataFrame, lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """Typed team-games. `lower_is_better` names sports where fewer points win."""
    typed = games.select(
        "sport", F.col("game_id").cast("string").alias("game_id"), "team", "opponent",
        F.try_to_date("game_date").alias("game_date"),
        *[to_number(F.col(c)).alias(c) for c in (
            "points_for", "points_against", "off_efficiency", "def_efficiency")])
    more = F.col("points_for") > F.col("points_against")
    if lower_is_better:
        fewer = F.col("points_for") < F.col("points_against")
        more = F.when(F.col("sport").isin(*lower_is_better), fewer).otherwise(more)
    columns = ["sport", "game_id", "team", "opponent", "game_date", "points_for",
               "points_against", "win", "off_efficiency", "def_efficiency"]
    return typed.withColumn("win", more.cast("int")).select(*columns)


# --- silver: rows that pass the rules -----------------------------------------

def silver_images(bronze: DataFrame) -> DataFrame:
    return IMAGE_RULES.keep(bronze)


def silver_keypoints(bronze: DataFrame) -> DataFrame:
    return KEYPOINT_RULES.keep(bronze)


def silver_games(bronze: DataFrame) -> DataFrame:
    return GAME_RULES.keep(bronze)


# --- gold: training tables (batch) --------------------------------------------

def training_manifest(images: DataFrame, keypoints: DataFrame, dedupe_images: bool = False,
                      by_split: bool = False) -> DataFrame:
    """Images with the counts of their instances; images without any are kept.

    The label files of boxes and of keypoints both list the images, so an image
    may occur twice; `dedupe_images` keeps one. Instances are matched on sport and
    image id; `by_split` also matches the split, where the instances carry it.
    """
    if dedupe_images:
        images = images.dropDuplicates(["sport", "split", "image_id"])
    on = ["sport", "split", "image_id"] if by_split else ["sport", "image_id"]
    stats = ["num_instances", "avg_visible_keypoints", "total_bbox_area"]
    per_image = keypoints.groupBy(*on).agg(
        F.count(F.lit(1)).alias(stats[0]),
        F.round(F.avg("num_visible_keypoints"), 2).alias(stats[1]),
        F.round(F.sum("bbox_area"), 1).alias(stats[2]))
    return (join_unique(images, per_image, on, "left")
            .na.fill(0, stats)
            .withColumn("has_pose", F.col("avg_visible_keypoints") > 0))


def athlete_metrics(keypoints: DataFrame, roster: DataFrame | None = None,
                    angles: bool = False) -> DataFrame:
    """Per-instance features; optionally the sport's angles and the athlete behind them.

    `roster` has one row per (sport, image_id, category_id) with athlete_id and,
    where known, further labels.
    """
    base = ["sport", "image_id", "category_id", "bbox_area", "num_visible_keypoints"]
    out = keypoints.select(*base, *(["keypoints"] if angles else []))
    if angles:
        found = sport_angles(F.col("keypoints"), F.col("sport"))
        out = out.withColumn("angles", F.map_from_entries(found)).drop("keypoints")
    if roster is not None:
        out = join_unique(out, roster, ["sport", "image_id", "category_id"], "left")
    return out


def angle_rows(keypoints: DataFrame, keys: list[str] = ("sport", "image_id", "category_id"),
               left_handed: Column | None = None, min_visibility: float | None = None) -> DataFrame:
    """(keys, angle, deg), one row per angle of the row's sport.

    The few positions of the sport's angles are laid out first, so one short
    expression serves all angles and stays in generated code.
    """
    triples = F.explode(angle_triples(F.col("sport"), left_handed)).alias("t")
    return keypoints.select(*keys, "keypoints", triples).select(
        *keys, "t.angle", triple_angle(F.col("keypoints"), F.col("t"), min_visibility).alias("deg"))


def team_game_features(games: DataFrame, previous: int = 5,
                       strength: DataFrame | None = None) -> DataFrame:
    """Games with the team's form before each game; equal dates are ordered by game id.

    `strength` may add one row of features per (sport, team, game_id).
    """
    group, order = ["sport", "team"], ["game_date", "game_id"]
    segments = find_segments(games, group, order)
    if strength is not None:
        games = join_unique(games, strength, ["sport", "team", "game_id"])
    return rolling_previous(games, group, order, {
        "form_points_for": "points_for", "form_points_against": "points_against",
        "form_win_rate": "win"}, previous, segments=segments)


def team_strength(athletes: DataFrame) -> DataFrame:
    """Per (sport, team, game_id) summary of the athletes' measures."""
    return athletes.groupBy("sport", "team", "game_id").agg(
        F.count(F.lit(1)).alias("num_athletes"),
        F.avg("bbox_area").alias("mean_bbox_area"),
        F.avg("num_visible_keypoints").alias("mean_visible_keypoints"))


def athlete_summary(athletes: DataFrame, window: str) -> DataFrame:
    """One row per athlete and window (a column, e.g. a season) from the instances."""
    return athletes.groupBy("sport", "athlete_id", window).agg(
        F.count(F.lit(1)).alias("num_instances"),
        F.avg("bbox_area").alias("mean_bbox_area"),
        F.max("num_visible_keypoints").alias("max_visible_keypoints"))


def check_visible(keypoints: DataFrame) -> DataFrame:
    """Add the count of points marked visible, to check the count the source gives."""
    return keypoints.withColumn("counted_visible", visible_points(F.col("keypoints")))
