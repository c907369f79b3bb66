"""Windows over ordered groups that stay balanced when one group is huge.

A plain Spark window puts a whole group into one task. Groups beyond the row
limit are cut here into segments of the order, bounded by fixed split points;
each segment is a window partition of its own, and what a segment needs from
those before it (the last few rows, a running total) is a small table. Split
points come from a sample and decide only the balance, never the result: they
are literals in the plan, so every task, also a repeated one, cuts alike.

Finding the segments reads the frame: pass tables, or results kept by
session.settle, or segments found on the table a frame was made from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.operators.hotkeys import MAX_HOT, hot_keys, join_unique, key_hash
from fieldmark.session import rows_per_task, settle

SEGMENT, _HASH, _BOUNDS = "__segment", "__group_hash", "__bounds"
_SAMPLE_PER_SEGMENT = 20


FIND = "find"


@dataclass
class Segments:
    """Split points of the hot groups, one small row per group hash."""

    group: list[str]
    order: list[str]
    bounds: DataFrame
    hashes: list[int]

    def is_hot(self) -> Column:
        return key_hash(self.group).isin(self.hashes)

    def tag(self, df: DataFrame) -> DataFrame:
        """Add the segment number; 0 for every row of the other groups."""
        value = F.struct(*self.order)
        steps = F.lit([2 ** p for p in range(MAX_HOT.bit_length(), -1, -1)])
        # Binary search: the number of split points not above the row.
        found = F.reduce(
            steps, F.lit(0),
            lambda low, step: F.when(
                (low + step <= F.size(_BOUNDS)) & (F.get(F.col(_BOUNDS), low + step - 1) <= value),
                low + step).otherwise(low))
        return (df.withColumn(_HASH, key_hash(self.group))
                .join(F.broadcast(self.bounds), _HASH, "left")
                .withColumn(SEGMENT, F.when(F.col(_BOUNDS).isNull(), F.lit(0)).otherwise(found))
                .drop(_HASH, _BOUNDS))


def find_segments(df: DataFrame, group: list[str], order: list[str],
                  limit: int | None = None) -> Segments | None:
    """Split points for groups above the row limit; None where there are none."""
    spark = df.sparkSession
    limit = limit or rows_per_task(spark)
    hot = hot_keys(df, group, limit)
    if not hot:
        return None
    hot_rows = sum(hot.values())
    limit = max(limit, hot_rows // MAX_HOT)
    wanted = max(2, hot_rows // limit + len(hot))
    fraction = min(1.0, _SAMPLE_PER_SEGMENT * wanted / hot_rows)
    keyed = df.select(key_hash(group).alias(_HASH), F.struct(*order).alias("o"))
    sample = keyed.where(F.col(_HASH).isin(list(hot))).sample(fraction, seed=7)
    pieces = F.create_map(*[x for h, n in hot.items()
                            for x in (F.lit(h), F.lit(max(2, -(-n // limit))))])
    # Every hot group contributes a bounded number of sampled rows.
    chosen = (sample.groupBy(_HASH)
              .agg(F.sort_array(F.collect_set("o")).alias("s"))
              .withColumn("step", F.greatest(F.lit(1), F.ceil(F.size("s") / pieces[F.col(_HASH)])))
              .select(_HASH, F.filter("s", lambda x, i: (i > 0) & (i % F.col("step") == 0))
                      .alias(_BOUNDS)))
    rows = chosen.collect()
    if not rows:
        return None
    bounds = spark.createDataFrame(rows, chosen.schema)
    return Segments(group, order, bounds, list(hot))


def _window(group: list[str]):
    return Window.partitionBy(*[F.col(g) for g in group]) if group else Window.partitionBy(F.lit(0))


def row_numbers(df: DataFrame, group: list[str], order: list[str], name: str = "rn",
                limit: int | None = None) -> DataFrame:
    """row_number() over (partition by group order by order); order must be unique."""
    return running_sums(df.withColumn("__one", F.lit(1).cast("bigint")), group, order,
                        {name: "__one"}, limit).drop("__one")


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str],
                 limit: int | None = None, segments=FIND) -> DataFrame:
    """Sums over the group up to and including the row; order must be unique."""
    seg = find_segments(df, group, order, limit) if segments is FIND else segments
    if seg is None:
        w = _window(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(c).over(w) for out, c in sums.items()})
    tagged = seg.tag(df)
    inner = (_window(group + [SEGMENT]).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0))
    joined = null_safe_join(tagged, segment_totals(tagged, seg, sums), group + [SEGMENT])
    return (joined.withColumns({out: F.sum(c).over(inner) for out, c in sums.items()})
            .withColumns({out: F.col(out) + F.coalesce(f"__b_{out}", F.lit(0)) for out in sums})
            .drop(SEGMENT, *[f"__b_{out}" for out in sums]))


def segment_totals(tagged: DataFrame, seg: Segments, sums: dict[str, str]) -> DataFrame:
    """For each segment of a hot group the sums (`__b_...`) over the segments before it: one row each."""
    before = _window(seg.group).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.where(seg.is_hot()).groupBy(*seg.group, SEGMENT)
            .agg(*[F.sum(c).alias(f"__t_{out}") for out, c in sums.items()])
            .select(*seg.group, SEGMENT, *[F.sum(f"__t_{out}").over(before).alias(f"__b_{out}")
                                           for out in sums]))


def following_max(df: DataFrame, group: list[str], order: list[str], maxima: dict[str, str],
                  limit: int | None = None, segments=FIND) -> DataFrame:
    """Largest values from the row to the end of its group."""
    # Running maximum in falling order: a frame that starts at the current row
    # and has no end would be computed anew for every row.
    falling = [F.col(o).desc() for o in order]
    seg = find_segments(df, group, order, limit) if segments is FIND else segments
    if seg is None:
        w = _window(group).orderBy(*falling).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.max(c).over(w) for out, c in maxima.items()})
    tagged = seg.tag(df)
    inner = (_window(group + [SEGMENT]).orderBy(*falling)
             .rowsBetween(Window.unboundedPreceding, 0))
    after = _window(group).orderBy(F.desc(SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)
    carried = (tagged.where(seg.is_hot()).groupBy(*group, SEGMENT)
               .agg(*[F.max(c).alias(f"__t_{out}") for out, c in maxima.items()])
               .select(*group, SEGMENT, *[F.max(f"__t_{out}").over(after).alias(f"__b_{out}")
                                       for out in maxima]))
    joined = null_safe_join(tagged, carried, group + [SEGMENT])
    return (joined.withColumns({out: F.greatest(F.max(c).over(inner), F.col(f"__b_{out}"))
                                for out, c in maxima.items()})
            .drop(SEGMENT, *[f"__b_{out}" for out in maxima]))


def rolling_previous(df: DataFrame, group: list[str], order: list[str],
                     averages: dict[str, str], rows: int = 5,
                     limit: int | None = None, segments=FIND) -> DataFrame:
    """Averages over the `rows` rows before each row, the row itself excluded.

    The first row of a group has no earlier one and gets NULL. Order must be unique.
    """
    seg = find_segments(df, group, order, limit) if segments is FIND else segments
    if seg is None:
        w = _window(group).orderBy(*order).rowsBetween(-rows, -1)
        return df.withColumns({out: F.avg(c).over(w) for out, c in averages.items()})
    values = sorted(set(averages.values()) - set(order) - set(group))
    tagged = seg.tag(df).withColumn("__own", F.lit(True))
    # Last rows of every segment of a hot group ...
    newest = _window(group + [SEGMENT]).orderBy(*[F.col(o).desc() for o in order])
    tails = (tagged.where(seg.is_hot())
             .select(*group, SEGMENT, *order, *values, F.row_number().over(newest).alias("__r"))
             .where(F.col("__r") <= rows)
             .groupBy(*group, SEGMENT)
             .agg(F.sort_array(F.collect_list(F.struct(*order, *values))).alias("__tail")))
    # ... and for each segment the last rows of those before it. Segments without
    # rows do not occur, so `rows` earlier segments always hold enough.
    earlier = _window(group).orderBy(SEGMENT).rowsBetween(-rows, -1)
    context = (tails
               .select(*group, SEGMENT, F.flatten(F.collect_list("__tail").over(earlier)).alias("__c"))
               .select(*group, SEGMENT, F.explode(
                   F.slice("__c", F.greatest(F.lit(1), F.size("__c") - rows + 1), rows)).alias("__c"))
               .select(*group, SEGMENT, "__c.*", F.lit(False).alias("__own")))
    both = tagged.unionByName(context, allowMissingColumns=True)
    w = _window(group + [SEGMENT]).orderBy(*order).rowsBetween(-rows, -1)
    return (both.withColumns({out: F.avg(c).over(w) for out, c in averages.items()})
            .where("__own").drop("__own", SEGMENT))


def null_safe_join(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    renamed = small.select(*[F.col(c).alias(f"__k_{c}") if c in on else F.col(c)
                             for c in small.columns])
    cond = None
    for c in on:
        eq = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        cond = eq if cond is None else cond & eq
    return big.join(F.broadcast(renamed), cond, "left").drop(*[f"__k_{c}" for c in on])


def values_at_positions(df: DataFrame, group: list[str], value: str,
                        positions: dict[str, Column], limit: int | None = None) -> DataFrame:
    """Per group the values at 0-based positions of the sorted values.

    `positions` are columns over `n`, the group's number of values. Equal values
    are counted before anything is ordered.
    """
    keys = group or ["__all"]
    if not group:
        df = df.withColumn("__all", F.lit(0))
    counted = settle(df.where(F.col(value).isNotNull()).groupBy(*keys, value)
                     .agg(F.count(F.lit(1)).alias("__n")), "value-counts")
    seg = find_segments(counted, keys, [value], limit)
    totals = counted.groupBy(*keys).agg(F.sum("__n").alias("n"))
    run = running_sums(counted, keys, [value], {"__upto": "__n"}, segments=seg)
    hits = [F.min(F.when(F.col("__upto") > pos, F.col(value))).alias(name)
            for name, pos in positions.items()]
    hot = dict.fromkeys(seg.hashes) if seg else {}
    out = join_unique(run, totals, keys, "inner", hot).groupBy(*keys).agg(*hits)
    return out if group else out.drop("__all")
