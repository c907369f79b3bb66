"""Write annotations as training label files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.geometry import label_line
from fieldmark.operators.hotkeys import join_unique


def label_lines(instances: DataFrame, images: DataFrame, with_pose: bool = False,
                digits: int = 6) -> DataFrame:
    """(sport, split, image_id, file_name, line), one per instance.

    `images` is unique per (sport, image_id); instances whose image is unknown drop out.
    """
    sized = images.select("sport", "image_id", "split", "file_name", "width", "height")
    both = join_unique(instances, sized, ["sport", "image_id"], "inner")
    pose = F.col("keypoints") if with_pose else None
    line = label_line(F.col("category_id"), F.col("bbox"), F.col("width"), F.col("height"), pose, digits)
    return both.select("sport", "split", "image_id", "file_name", line.alias("line"))


def export_lines(lines: DataFrame, path: str) -> str:
    """Store the lines by sport, split and image.

    Every image is a folder of text, so an image with very many instances is
    written by several tasks.
    """
    (lines.select("sport", "split", "image_id", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("sport", "split", "image_id").text(path))
    return path
