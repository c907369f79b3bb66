"""Every registered query against its SQL on DuckDB, and once more with all keys counted as hot."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

# Queries that go through the hot key or segment paths when the limit is low.
SKEWED = ["rolling_form", "typed_games", "training_manifest", "roster_link", "team_strength",
          "athlete_summary", "label_equals", "roc_auc_exact", "group_metrics", "latency_percentiles",
          "leaderboard_sorted", "box_map", "box_average_precision", "pose_map", "yolo_lines", "accuracy_f1"]


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", SKEWED)
def test_equals_sql_with_hot_keys(spark, duck, low_limit, name):
    assert compare(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
