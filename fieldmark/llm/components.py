"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.session import discard
from fieldmark.session import settle_lean as settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of alternating stars (Kiveris et al. 2014): every node links its neighbours to the least."""
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
    if large:
        both = both.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    least = least.withColumn("least", F.least("u", "least"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("least").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("least").alias("a"), F.col("v").alias("b")).where("a <> b")
        out = out.unionByName(least.select(F.col("least").alias("a"), F.col("u").alias("b")))
    return out.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): component is the least node that can be reached.

    Only nodes with a link appear. Alternating large and small stars until nothing
    changes, each round settled in the shared folder; neighbour lists are never
    collected, a node of any degree is a minimum and a join. Links from a node to
    itself and repeated ones do not matter.
    """
    now = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        wide = settle(_star(now, True), "links")
        before, now = now, settle(_star(wide, False), "links")
        discard(before, wide)
    return (now.select(F.col("b").alias("node"), F.col("a").alias("component"))
            .unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()))
