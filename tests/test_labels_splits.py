import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import labels as lab
from fieldmark.operators import splits
from fieldmark.plans.grid import Cell, SweepConfig, expand_grid, grid_frame
from fieldmark.registry import DATASETS


def _raw(spark, spec, n=400):
    """Text rows with the columns of a dataset: five of six rows pass the filters."""
    rng = np.random.default_rng(0)
    cols = {c: rng.normal(50, 15, n).astype(str) for c in spec.numeric}
    cols |= {c: rng.choice(list("ABCD"), n) for c in spec.categorical}
    for c, allowed in spec.filters.items():
        cols[c] = rng.choice([f" {allowed[0]} "] * 5 + ["ZZ"], n)
    cols[spec.target[0]] = rng.normal(80000, 25000, n).astype(str)
    cols[spec.target[0]][:3] = ["9999998", "", "n/a"]
    names = list(cols)
    return spark.createDataFrame([tuple(str(cols[c][i]) for c in names) for i in range(n)],
                                 ", ".join(f"`{c}` string" for c in names))


@pytest.mark.parametrize("name", sorted(DATASETS))
def test_silver_of_every_dataset(spark, name):
    spec = DATASETS[name]
    raw = _raw(spark, spec)
    silver = lab.to_silver(spec, raw).cache()
    kept = lab.allow_rows(raw, spec.filters)
    labelled = kept.where(lab.clean_number(F.col(spec.target[0]), spec.sentinel_min).isNotNull())
    assert silver.count() == labelled.count()
    ones = silver.where("label = 1").count()
    assert abs(ones - silver.count() / 2) <= 1
    numeric, categorical = lab.column_types(silver, skip=("label",))
    assert set(numeric) <= set(spec.numeric) and set(categorical) == set(spec.categorical)
    x, y = lab.split_silver(silver)
    assert "label" not in x.columns and y.columns == ["label"]


def test_fallback_target_is_no_feature(spark):
    spec = DATASETS["pisa_2022"]
    raw = _raw(spark, spec).drop("BSMJ")
    assert "PV1MATH" not in lab.to_silver(spec, raw).columns
    with pytest.raises(KeyError):
        lab.first_present(raw, ["nope"])


def test_ties_and_gaps_of_the_median_label(spark):
    df = spark.createDataFrame([("1",), ("2",), ("2",), ("3",), ("NaN",), (None,)], "SALARY string")
    spec = lab.Dataset("d", ("SALARY",), (), ())
    got = [r[0] for r in df.select(lab.label_column(spec, df)).collect()]
    assert got == [0, 0, 0, 1, None, None]


def test_share_out_matches_the_known_sizes():
    assert splits.share_out({0: 50, 1: 50}, 20) == {0: 10, 1: 10}
    assert sum(splits.share_out({0: 33, 1: 33, 2: 33}, 50).values()) == 50
    sizes = splits.fold_sizes({0: 7, 1: 6}, 5)
    assert sizes == {0: [2, 2, 1, 1, 1], 1: [1, 1, 2, 1, 1]}


@pytest.mark.parametrize("seed", [None, 42])
@pytest.mark.parametrize("exact_below", [100_000, 25])
def test_splits(spark, seed, exact_below):
    df = spark.range(1000).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
    n1 = df.where("label = 1").count()
    held = splits.hold_out(df, "label", "id", 0.2, seed, exact_below)
    got = {r["label"]: r["n"] for r in held.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == splits.share_out({0: 1000 - n1, 1: n1}, 200)
    fold = splits.folds(df, "label", "id", 5, seed, exact_below)
    by = {(r["label"], r["fold"]): r["n"] for r in fold.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    want = splits.fold_sizes({0: 1000 - n1, 1: n1}, 5)
    assert by == {(c, f): want[c][f] for c in want for f in range(5)}
    assert splits.row_cap(df, "label", "id", 300, seed, exact_below).count() == 300
    assert splits.row_cap(df, "label", "id", 0, seed).count() == 1000
    plain = splits.hold_out(df, None, "id", 0.15, seed, exact_below)
    assert plain.where("is_test").count() == math.ceil(150)


def test_hash_order_follows_the_seed(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).cast("int").alias("label"))
    def held(seed):
        return {r["id"] for r in splits.hold_out(df, "label", "id", 0.2, seed).where("is_test").collect()}
    assert held(1) == held(1) and held(1) != held(2)


def test_grid(spark):
    cfg = SweepConfig(datasets=("d",), reducers=("none", "pca"), n_components=(5, 8),
                      clustering=("none", "kmeans"), models=("logistic_regression", "knn"))
    cells = expand_grid(cfg)
    assert len(cells) == 12 and sum(c.reducer == "none" for c in cells) == 4
    assert len(expand_grid(SweepConfig())) == 192
    frame = grid_frame(spark.createDataFrame([("d",), ("d",)], "dataset string"), cfg)
    assert {Cell(*r) for r in frame.collect()} == set(cells) and frame.count() == 12
    assert Cell("d", "none", None, "none", "knn").name == "d|none|k-1|none|knn"


def test_hold_out_tells_rows_of_one_entity_apart(spark):
    df = spark.range(1000).selectExpr("'A' AS team", "id AS game_id", "id % 2 AS label")
    assert splits.hold_out(df, "label", ["team", "game_id"], 0.2).where("is_test").count() == 200
