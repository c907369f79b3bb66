"""Incremental refinement: landing, bronze and silver as streams, gold as a batch job.

Every layer is a folder of Parquet below `out`. A stream remembers in its
checkpoint which files it has read; a later run takes up only what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldmark.plans import refinement as r
from fieldmark.sources import landing
from fieldmark.sources.sinks import replace_path

# target layer -> (source layer, row-by-row transformation)
STEPS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "bronze/images": ("landing/raw_labels", r.bronze_images),
    "bronze/keypoints": ("landing/raw_labels", r.bronze_keypoints),
    "bronze/games": ("landing/games", r.bronze_games),
    "silver/images": ("bronze/images", r.silver_images),
    "silver/keypoints": ("bronze/keypoints", r.silver_keypoints),
    "silver/games": ("bronze/games", r.silver_games),
}


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything that is there now, then stop."""
    (df.writeStream.format("parquet").option("path", path)
     .option("checkpointLocation", checkpoint).outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_layer(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A layer's folder as a stream; its schema is that of the rows already there."""
    reader = spark.readStream.schema(read_layer(spark, path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def land(spark: SparkSession, root: str, out: str, sources=("raw_labels", "frames", "games"),
         multi_line: bool = True, frame_glob: str = "*.jpg", max_files: int | None = None) -> None:
    readers = {
        "raw_labels": lambda: landing.labels(spark, f"{root}/labels", True, multi_line, max_files),
        "frames": lambda: landing.frames(spark, f"{root}/images", True, frame_glob, max_files),
        "games": lambda: landing.games(spark, f"{root}/games", True, max_files=max_files),
    }
    for name in sources:
        run_available(readers[name](), f"{out}/landing/{name}", f"{out}/_checkpoints/landing/{name}")


def refine(spark: SparkSession, out: str, steps=tuple(STEPS), max_files: int | None = None) -> None:
    for target in steps:
        source, transform = STEPS[target]
        rows = transform(stream_layer(spark, f"{out}/{source}", max_files))
        run_available(rows, f"{out}/{target}", f"{out}/_checkpoints/{target}")


def gold(spark: SparkSession, out: str) -> None:
    """Recompute the training tables from silver: a late game changes later rows."""
    images, keypoints, games = (read_layer(spark, f"{out}/silver/{n}")
                                for n in ("images", "keypoints", "games"))
    replace_path(r.training_manifest(images, keypoints), f"{out}/gold/training_manifest", ["sport"])
    replace_path(r.athlete_metrics(keypoints), f"{out}/gold/athlete_metrics", ["sport"])
    replace_path(r.team_game_features(games), f"{out}/gold/team_game_features", ["sport"])


def ingest(spark: SparkSession, root: str, out: str, **options) -> None:
    """All layers, once."""
    land(spark, root, out, **options)
    refine(spark, out)
    gold(spark, out)


def manifest(spark: SparkSession, out: str, sport: str, split: str | None = None) -> DataFrame:
    """The training manifest of a sport, or of one of its splits."""
    rows = read_layer(spark, f"{out}/gold/training_manifest").where(f"sport = '{sport}'")
    return rows if split is None else rows.where(f"split = '{split}'")
