"""Segmented windows, selections and joins against plain ones."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldmark.operators import hotkeys, ordered, selection


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a"] * 6 + ["b", "c", None]), rng.randrange(300), i, float(rng.randrange(-900, 900)))
            for i in range(4000)]
    return spark.createDataFrame(data, "g string, d int, id int, v double").repartition(6).cache()


@pytest.fixture(scope="module")
def expected(rows):
    w = Window.partitionBy("g").orderBy("d", "id")
    out = rows.select(
        "id", F.avg("v").over(w.rowsBetween(-5, -1)).alias("form"),
        F.row_number().over(w).alias("rn"), F.sum("v").over(w).alias("run"),
        F.max("v").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("peak"))
    return {r["id"]: r for r in out.collect()}


@pytest.mark.parametrize("limit", [None, 50, 500])
def test_windows(rows, expected, limit):
    g, o = ["g"], ["d", "id"]
    frames = {
        "form": ordered.rolling_previous(rows, g, o, {"form": "v"}, limit=limit),
        "rn": ordered.row_numbers(rows, g, o, "rn", limit=limit),
        "run": ordered.running_sums(rows, g, o, {"run": "v"}, limit=limit),
        "peak": ordered.following_max(rows, g, o, {"peak": "v"}, limit=limit),
    }
    for name, df in frames.items():
        got = df.collect()
        assert len(got) == 4000 and set(df.columns) == {*rows.columns, name}
        assert all(r[name] == expected[r["id"]][name] for r in got), name


def test_hot_group_is_cut(rows):
    seg = ordered.find_segments(rows, ["g"], ["d", "id"], 100)
    sizes = [r["count"] for r in seg.tag(rows).groupBy("g", "__segment").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 600


def test_one_timestamp_for_all(spark):
    """A hot group whose rows share the first order column is cut by the second."""
    df = spark.range(2000).select(F.lit(0).alias("g"), F.lit(1).alias("d"), "id", F.lit(1.0).alias("v"))
    seg = ordered.find_segments(df, ["g"], ["d", "id"], 100)
    assert seg.tag(df).select("__segment").distinct().count() > 10
    got = ordered.row_numbers(df, ["g"], ["d", "id"], "rn", 100).where(F.col("rn") != F.col("id") + 1)
    assert got.count() == 0


@pytest.mark.parametrize("limit", [None, 40])
def test_positions(rows, limit):
    got = ordered.values_at_positions(rows, ["g"], "v", {"p": F.floor(F.col("n") / 2)}, limit).collect()
    by_group = {}
    for r in rows.collect():
        by_group.setdefault(r["g"], []).append(r["v"])
    want = {g: sorted(v)[len(v) // 2] for g, v in by_group.items() if g is not None}
    assert {r["g"]: r["p"] for r in got if r["g"] is not None} == want


@pytest.mark.parametrize("exact_below", [100_000, 60, 3])
def test_selection(rows, exact_below):
    columns = {"v": F.col("v"), "d": F.col("d"), "same": F.lit(2.0), "none": F.when(F.col("id") < 0, 1.0)}
    got = selection.medians(rows, columns, exact_below)
    want = rows.agg(F.median("v").alias("v"), F.median("d").alias("d")).first()
    assert got == {"v": want["v"], "d": want["d"], "same": 2.0, "none": None}


def test_selection_with_a_heavy_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("x"))
    got = selection.values_at_ranks(df, {"x": F.col("x")}, lambda _, n: [1, 2999, 3001, n], 10)
    assert got == {"x": [7, 7, 3000, 4999]}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_unique(rows, spark, how):
    right = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "g string, w int")
    want = sorted(map(str, rows.join(right, ["g"], how).collect()))
    hot = hotkeys.hot_keys(rows, ["g"], 300)
    assert 1 < len(hot) < 5
    assert sorted(map(str, hotkeys.join_unique(rows, right, ["g"], how, hot).collect())) == want


def test_small_inputs_have_no_hot_keys(rows):
    assert hotkeys.hot_keys(rows, ["g"]) == {}
