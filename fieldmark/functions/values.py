"""Scalar column helpers: coercion, masking, keys cut from paths, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: where sport and split stand in a path ----------------------
LABEL_SPORT = r"/labels/([^/]+)/"
LABEL_SPLIT = r"_(train|val|test)\.json$"
IMAGE_SPORT = r"/images/([^/]+)/"
IMAGE_SPLIT = r"/images/[^/]+/([^/]+)/"
GAME_SPORT = r"/games/([^/]+)/"


def path_key(path: Column, pattern: str) -> Column:
    """First group of the pattern, '' where it does not match."""
    return F.regexp_extract(path, pattern, 1)


def nan_to_null(c: Column) -> Column:
    """Spark sorts NaN above every number, so metrics carry NULL instead."""
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """Double, NULL where the text is no number (or says NaN)."""
    return nan_to_null(c.try_cast("double"))


def mask_sentinel(c: Column, sentinel: float) -> Column:
    """NULL for values at or above the sentinel."""
    return F.when(c < F.lit(sentinel), c)


def to_category(c: Column) -> Column:
    """Text; a missing value is the category ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def in_list(c: Column, allowed) -> Column:
    return F.trim(c.cast("string")).isin([str(v) for v in allowed])


def cell_name(dataset: Column, reducer: Column, components: Column, clustering: Column,
              model: Column) -> Column:
    """dataset|reducer|k<n>|clustering|model"""
    return F.concat_ws("|", dataset, reducer, F.concat(F.lit("k"), components.cast("string")),
                       clustering, model)


def run_name(sport: Column, key: Column) -> Column:
    return F.concat_ws("_", sport, key)


def encode_components(c: Column) -> Column:
    """No component count is stored as -1."""
    return F.coalesce(c.cast("int"), F.lit(-1))


def decode_components(c: Column) -> Column:
    return F.when(c >= 0, c)
