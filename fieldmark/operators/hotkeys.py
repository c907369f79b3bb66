"""Keys that hold a large share of the rows, and joins that stay balanced with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.session import rows_per_task

# Upper bound for the number of keys treated as hot, whatever the data size.
MAX_HOT = 4096


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], limit: int | None = None) -> dict[int, int]:
    """Hash -> row count of the keys with more rows than one task should get.

    Rows are counted first; small inputs stop there. Otherwise one pass with the
    mergeable frequent-items aggregate names at most MAX_HOT candidates (it
    misses no key above its support) and a second pass counts those. Only hashes
    and counts reach the driver.
    """
    limit = limit or rows_per_task(df.sparkSession)
    total = df.count()
    if total <= limit:
        return {}
    limit = max(limit, total // MAX_HOT)
    hashes = df.select(key_hash(keys).alias("h"))
    support = max(limit / total, 1.0 / MAX_HOT)
    found = hashes.stat.freqItems(["h"], min(support, 0.999)).first()[0]
    if not found:
        return {}
    rows = (hashes.where(F.col("h").isin(list(found))).groupBy("h").count()
            .where(F.col("count") > limit).collect())
    return {r["h"]: r["count"] for r in rows}


def join_unique(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                hot: dict[int, int] | None = None) -> DataFrame:
    """Join to a side that has each key at most once, or a fixed few times.

    Rows of hot keys on the left are joined by broadcasting their matches: at
    most MAX_HOT keys with those few rows each. The rest is joined in the usual way.
    """
    if hot is None:
        hot = hot_keys(left, on)
    if not hot:
        return left.join(right, on, how)
    is_hot = key_hash(on).isin(list(hot))
    cold = left.where(~is_hot).join(right.where(~is_hot), on, how)
    spread = left.where(is_hot).join(F.broadcast(right.where(is_hot)), on, how)
    return cold.unionByName(spread)


def broadcast_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Mark a frame for broadcast if it is counted to be small; else leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
