"""Queries: landed text to modelling tables, labels, column roles, preprocessing."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fieldmark.catalog.base import Tables, query
from fieldmark.catalog.refinement import games
from fieldmark.functions.values import mask_sentinel, to_number
from fieldmark.operators import labels as lab
from fieldmark.operators.hotkeys import join_unique
from fieldmark.operators.preprocess import (category_counts, fit_numeric, fit_preprocess,
                                            most_frequent)
from fieldmark.plans.refinement import team_game_features
from fieldmark.plans.targets import feature_columns as target_features
from fieldmark.plans.targets import missing_columns as target_gaps
from fieldmark.registry import TARGETS, Dataset


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def allowlist_filter(spark, sf):
    padded = Tables(spark, sf).customer.select(
        "c_custkey", F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")).alias("c_mktsegment"))
    kept = lab.allow_rows(padded, {"c_mktsegment": ("BUILDING", "MACHINERY"), "absent": ("1",)})
    return kept.select("c_custkey", F.trim("c_mktsegment").alias("c_mktsegment"))


def _dirty(k):
    kind = F.col("event_type")
    return (F.when(kind == "error", F.lit("n/a")).when(kind == "click", F.lit("NaN"))
            .when(kind == "view", F.lit("")).when(kind == "signup", F.concat(F.lit(" "), k, F.lit(" ")))
            .otherwise(k))


@query(r"""SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase')
                  THEN CAST(regexp_extract(props, '"k": (\d+)', 1) AS DOUBLE) END AS k FROM events""")
def numeric_coerce(spark, sf):
    k = F.regexp_extract("props", r'"k": (\d+)', 1)
    return Tables(spark, sf).events.select("event_id", to_number(_dirty(k)).alias("k"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_acctbal END AS c_acctbal
          FROM customer""")
def sentinel_mask(spark, sf):
    held = F.when(F.col("c_mktsegment") == "FURNITURE", 9999998.0).otherwise(F.col("c_acctbal"))
    return Tables(spark, sf).customer.select(
        "c_custkey", mask_sentinel(held, 9_999_990.0).alias("c_acctbal"))


_BALANCE = Dataset("balance", target=("not_there", "c_acctbal"), numeric=("c_acctbal", "c_nationkey"),
                   categorical=("c_mktsegment",),
                   filters={"c_mktsegment": ("BUILDING", "MACHINERY", "FURNITURE")})


def _raw_customers(t: Tables):
    """Customers as landed: text only, one segment with a sentinel, another without a value."""
    segment = F.col("c_mktsegment")
    text = (F.when((segment == "FURNITURE") & (F.col("c_nationkey") < 5), F.lit("9999998"))
            .when((segment == "MACHINERY") & (F.col("c_nationkey") > 20), F.lit(""))
            .otherwise(F.col("c_acctbal").cast("string")))
    return t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("c_nationkey"),
                             segment, text.alias("c_acctbal"))


_BALANCE_SQL = """
    c AS (SELECT c_custkey, c_nationkey, c_mktsegment,
                 CASE WHEN NOT (c_mktsegment = 'FURNITURE' AND c_nationkey < 5)
                       AND NOT (c_mktsegment = 'MACHINERY' AND c_nationkey > 20) THEN c_acctbal END AS v
          FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')),
    l AS (SELECT c_custkey, c_nationkey, c_mktsegment,
                 CAST(v > (SELECT median(v) FROM c) AS INTEGER) AS label FROM c WHERE v IS NOT NULL)"""


@query(f"WITH {_BALANCE_SQL} SELECT c_custkey, label FROM l")
def median_label(spark, sf):
    rows = lab.allow_rows(_raw_customers(Tables(spark, sf)), _BALANCE.filters)
    return rows.select("c_custkey", lab.label_column(_BALANCE, rows).alias("label")).dropna()


@query(f"""WITH {_BALANCE_SQL}
    SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_mktsegment, label FROM l""")
def silver_table(spark, sf):
    """The used target c_acctbal is listed as a feature too and must not come out as one."""
    return lab.to_silver(_BALANCE, _raw_customers(Tables(spark, sf)), keep=("c_custkey",))


@query(f"""WITH {_BALANCE_SQL}
    SELECT 'balance' AS dataset, count(*) AS rows, 3 AS columns, 2 AS features,
           round(avg(label), 3) AS positive_rate FROM l""")
def dataset_profile(spark, sf):
    return lab.profile(lab.to_silver(_BALANCE, _raw_customers(Tables(spark, sf))), "balance")


_QUALITY = Dataset("quality", target=("quality",), numeric=("n_chars",), categorical=("lang", "source"),
                   target_kind="label_equals", positive_label="1")


@query("""SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS n_chars, lang, source,
                 coalesce(CAST(quality = 1 AS INTEGER), 0) AS label
          FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def label_equals(spark, sf):
    """Documents without a judgement do not equal the positive label."""
    t = Tables(spark, sf)
    both = join_unique(t.documents.select("doc_id", "n_chars", "lang", "source"), t.labels, ["doc_id"])
    return lab.to_silver(_QUALITY, both, keep=("doc_id",))


@query("SELECT c_custkey, c_acctbal FROM customer")
def schema_select(spark, sf):
    return lab.select_present(Tables(spark, sf).customer,
                              ["c_custkey", "c_birthday", "c_acctbal", "c_custkey"])


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS filled, CAST(max({c}) AS DOUBLE) AS largest FROM lineitem"
    for c in _LINE_NUMBERS))
def numeric_columns(spark, sf):
    """The columns that count as numeric, with their fill and largest value."""
    df = Tables(spark, sf).lineitem
    numeric, _ = lab.column_types(df)
    return df.agg(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("filled"),
                             F.max(c).cast("double").alias("largest")).alias(c) for c in numeric]
                  ).select(F.explode(F.array(*numeric)).alias("r")).select("r.*")


def _features(t: Tables):
    """Feature table of the targets with its labels, on orders."""
    return (team_game_features(games(t))
            .withColumn("off_efficiency", F.col("points_for") / 1000)
            .withColumn("def_efficiency", F.col("points_against") / 1000))


@query("""
    WITH n AS (SELECT count(*) AS games, count(DISTINCT (o_orderstatus, o_custkey)) AS teams FROM orders)
    SELECT t.target, f.feature, games - teams AS filled
    FROM n, (VALUES ('win_probability'), ('points_for'), ('points_against'), ('off_efficiency'),
                    ('def_efficiency')) t(target),
         (VALUES ('form_points_for'), ('form_points_against'), ('form_win_rate')) f(feature)""")
def feature_columns(spark, sf):
    """Which columns feed which target, and in how many rows they are filled."""
    df = _features(Tables(spark, sf))
    pairs = [(t.key, c) for t in TARGETS.values() if t.scope == "team_game"
             for c in target_features(df, t)]
    names = sorted({c for _, c in pairs})
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("target"), F.lit(c).alias("feature"), F.col(c).alias("filled"))
        for k, c in pairs])).alias("r")).select("r.*")


@query("""
    SELECT t.target, t.missing, CASE WHEN t.scope = 1 THEN (SELECT count(*) FROM orders)
                                     ELSE (SELECT count(*) FROM lineitem) END AS rows
    FROM (VALUES ('win_probability', '', 1), ('points_for', '', 1), ('points_against', '', 1),
                 ('off_efficiency', 'off_efficiency', 1), ('def_efficiency', 'def_efficiency', 1),
                 ('player_index', 'athlete_id,player_rating', 2),
                 ('scholarship_roi', 'athlete_id,roi', 2)) t(target, missing, scope)""")
def missing_columns(spark, sf):
    """What each target still lacks in its feature table, and the rows of that table."""
    t = Tables(spark, sf)
    tables = {"team_game_features": games(t), "athlete_metrics": t.lineitem}
    found = {n: df.agg(F.count(F.lit(1)).alias("rows")) for n, df in tables.items()}
    out = None
    for key, target in TARGETS.items():
        gaps = ",".join(target_gaps(target, tables[target.feature_table]))
        row = found[target.feature_table].select(F.lit(key).alias("target"), F.lit(gaps).alias("missing"),
                                                 "rows")
        out = row if out is None else out.unionByName(row)
    return out


# --- preprocessing ------------------------------------------------------------

_GAPPY = "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END"


@query(f"""
    WITH c AS (SELECT c_custkey, {_GAPPY} AS v, CAST(c_nationkey AS DOUBLE) AS k FROM customer)
    SELECT c_custkey, coalesce(v, (SELECT median(v) FROM c)) AS v, k FROM c""")
def median_impute(spark, sf):
    df = Tables(spark, sf).customer.select(
        "c_custkey", F.expr(f"CASE WHEN c_mktsegment = 'BUILDING' THEN CAST('NaN' AS DOUBLE) "
                            f"ELSE c_acctbal END").alias("v"),
        F.col("c_nationkey").cast("double").alias("k"))
    fits = fit_numeric(df, ["v", "k"])
    return df.select("c_custkey", *[F.expr(f.sql(c, scale=False)).alias(c) for c, f in fits.items()])


@query("""
    WITH m AS (SELECT p_partkey, p_retailprice,
                      coalesce(CASE WHEN p_type <> 'SMALL' THEN p_size END,
                               (SELECT median(p_size) FROM part WHERE p_type <> 'SMALL')) AS s FROM part),
    a AS (SELECT avg(s) AS ms, stddev_pop(s) AS ds, avg(p_retailprice) AS mp,
                 stddev_pop(p_retailprice) AS dp FROM m)
    SELECT p_partkey, round((s - ms) / ds, 6) AS p_size,
           round((p_retailprice - mp) / dp, 6) AS p_retailprice, 0.0::DOUBLE AS same
    FROM m, a""")
def standard_scale(spark, sf):
    """Fill with the median, then scale; a constant column becomes 0."""
    df = Tables(spark, sf).part.select(
        "p_partkey", F.when(F.col("p_type") != "SMALL", F.col("p_size")).alias("p_size"),
        "p_retailprice", F.lit(7.0).alias("same"))
    fits = fit_numeric(df, ["p_size", "p_retailprice", "same"])
    return df.select("p_partkey", *[F.round(F.expr(f.sql(c)), 6).alias(c) for c, f in fits.items()])


@query("""
    WITH n AS (SELECT CAST(o_custkey AS VARCHAR) AS v, count(*) AS c FROM orders GROUP BY 1),
    r AS (SELECT v, row_number() OVER (ORDER BY c DESC, v) AS r, count(*) OVER () AS total FROM n),
    p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS r
          FROM orders GROUP BY 1)
    SELECT o_orderkey, CAST(CASE WHEN r.r <= 49 OR r.total <= 50 THEN r.r ELSE 50 END AS INTEGER) AS customer_at,
           CAST(p.r AS INTEGER) AS priority_at
    FROM orders JOIN r ON r.v = CAST(o_custkey AS VARCHAR) JOIN p ON p.v = o_orderpriority""")
def onehot_top49(spark, sf):
    """Positions of the 1 among at most 50 customer columns, then among the priorities."""
    df = Tables(spark, sf).orders.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("customer"), "o_orderpriority")
    steps = fit_preprocess(df, [], ["customer", "o_orderpriority"])
    x = vector_to_array("features")
    return steps.transform(df).select("o_orderkey", x.alias("x")).select(
        "o_orderkey",
        F.array_position(F.slice("x", 1, 50), 1.0).cast("int").alias("customer_at"),
        F.array_position(F.slice("x", 51, 50), 1.0).cast("int").alias("priority_at"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM part GROUP BY 2"
    for c in ("p_brand", "p_type", "p_name")))
def category_frequencies(spark, sf):
    counts = category_counts(Tables(spark, sf).part, ["p_brand", "p_type", "p_name"])
    return counts.withColumnRenamed("count", "n")


@query("""
    WITH p AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_type END AS p_type FROM part)
    SELECT p_partkey, coalesce(p_type, (SELECT p_type FROM p WHERE p_type IS NOT NULL
                                        GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1)) AS p_type
    FROM p""")
def most_frequent_fill(spark, sf):
    df = Tables(spark, sf).part.select("p_partkey",
                                       F.when(F.col("p_size") > 10, F.col("p_type")).alias("p_type"))
    return df.na.fill(most_frequent(df, ["p_type"]))
