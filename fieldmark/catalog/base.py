"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.registry import SPORTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


class Tables:
    """The test tables of one scale factor, read lazily and pruned by the plan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def pick(names, number: Column) -> Column:
    """The name at position number modulo their count."""
    return F.get(F.array(*[F.lit(n) for n in names]), F.pmod(number, F.lit(len(names))).cast("int"))


def sql_pick(names, number: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"([{listed}])[CAST(({number}) % {len(names)} AS INTEGER) + 1]"


SPORT_NAMES = list(SPORTS)
