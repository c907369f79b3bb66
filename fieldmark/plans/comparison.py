"""Compare the registered vision models by their newest finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmark.operators.leaderboard import compare_models
from fieldmark.registry import comparison_schema, models_frame
from fieldmark.sources.sinks import replace_slices


def comparison_rows(spark: SparkSession, runs: DataFrame, sports: list[str]) -> DataFrame:
    """compare_models in the fixed column order and types of the result table."""
    schema = comparison_schema()
    found = compare_models(models_frame(spark), runs, sports)
    return found.select(*[found[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def write_comparison(spark: SparkSession, runs: DataFrame, sport: str, path: str) -> str:
    """Replace one sport's slice of the comparison table; without any run this is an error."""
    rows = comparison_rows(spark, runs, [sport])
    if rows.isEmpty():
        raise RuntimeError(f"no finished runs for sport {sport!r}")
    return replace_slices(rows, path, "sport")
