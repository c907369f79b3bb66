"""Queries: flattening, typing, row rules, features of games and athletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.catalog.base import SPORT_NAMES, Tables, pick, query, sql_pick
from fieldmark.operators.hotkeys import join_unique
from fieldmark.operators.quality import GAME_RULES, Rules
from fieldmark.operators.sports import event_counts, name_classes, team_scores
from fieldmark.plans import refinement as r
from fieldmark.registry import SPORTS

_SPLITS = "CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'val' END"


def games(t: Tables):
    """Orders as team-games: the customer is the team, the status the sport."""
    return t.orders.select(
        F.col("o_orderstatus").alias("sport"), F.col("o_custkey").alias("team"),
        F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("game_date"),
        F.col("o_totalprice").alias("points_for"),
        F.pmod("o_orderkey", F.lit(1000)).cast("double").alias("points_against"),
        (F.col("o_totalprice") > 250000).cast("int").alias("win"))


_FORM = """avg({c}) OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderdate, o_orderkey
           ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""


@query(f"""
    SELECT o_orderkey AS game_id, o_custkey AS team,
           round({_FORM.format(c='o_totalprice')}, 4) AS form_points_for,
           round({_FORM.format(c='CAST(o_orderkey % 1000 AS DOUBLE)')}, 4) AS form_points_against,
           round({_FORM.format(c='CAST(o_totalprice > 250000 AS INTEGER)')}, 6) AS form_win_rate
    FROM orders""")
def rolling_form(spark, sf):
    out = r.team_game_features(games(Tables(spark, sf)))
    return out.select("game_id", "team", F.round("form_points_for", 4).alias("form_points_for"),
                      F.round("form_points_against", 4).alias("form_points_against"),
                      F.round("form_win_rate", 6).alias("form_win_rate"))


def label_documents(t: Tables):
    """Every line item as a small annotation document: two instances, none, or no list."""
    sport = pick(SPORT_NAMES, F.col("l_orderkey"))
    first = F.struct(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("category_id"),
        F.array(F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"),
                F.col("l_quantity"), F.col("l_extendedprice")).alias("bbox"),
        F.lit(None).cast("array<double>").alias("keypoints"),
        F.when(F.col("l_discount") > 0.05, F.lit(17)).alias("num_keypoints"))
    second = F.struct(
        F.col("l_orderkey").alias("image_id"), F.lit(0).alias("category_id"),
        F.array().cast("array<double>").alias("bbox"),
        F.lit(None).cast("array<double>").alias("keypoints"), F.lit(3).alias("num_keypoints"))
    kind = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    both = F.array(first, second)
    return t.lineitem.select(
        F.when(kind == "NO", F.slice(both, 1, 0)).when(kind != "RO", both).alias("annotations"),
        F.concat(F.lit("/data/labels/"), sport, F.lit("/person_keypoints_"),
                 F.expr(_SPLITS), F.lit(".json")).alias("source_file"))


@query(f"""
    WITH l AS (SELECT *, {sql_pick(SPORT_NAMES, 'l_orderkey')} AS sport, {_SPLITS} AS split
               FROM lineitem WHERE l_returnflag || l_linestatus NOT IN ('NO', 'RO'))
    SELECT l_orderkey AS image_id, l_linenumber AS category_id,
           l_quantity * l_extendedprice AS bbox_area,
           CASE WHEN l_discount > 0.05 THEN 17 ELSE 0 END AS num_visible_keypoints, sport, split
    FROM l
    UNION ALL
    SELECT l_orderkey, 0, CAST(NULL AS DOUBLE), 3, sport, split FROM l""")
def explode_annotations(spark, sf):
    out = r.bronze_keypoints(label_documents(Tables(spark, sf)), with_split=True)
    return out.drop("bbox", "keypoints")


@query(r"""
    WITH p AS (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
                      CASE WHEN url LIKE '%#%' THEN 'other'
                           WHEN url LIKE 'https%' THEN 'train' ELSE 'test' END AS part FROM pages),
    q AS (SELECT page_id AS image_id, url AS file_name, CAST(length(url) AS INTEGER) AS width,
                 CAST(length(html) AS INTEGER) AS height, host AS sport,
                 CASE WHEN part = 'other' THEN '' ELSE part END AS split FROM p)
    SELECT * FROM q
    UNION ALL
    SELECT -1 - image_id, NULL, 0, 0, sport, split FROM q""")
def explode_images(spark, sf):
    p = Tables(spark, sf).pages
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    part = (F.when(F.col("url").contains("#"), "other")
            .when(F.col("url").startswith("https"), "train").otherwise("test"))
    images = F.array(
        F.struct(F.col("page_id").alias("id"), F.col("url").alias("file_name"),
                 F.length("url").alias("width"), F.length("html").alias("height")),
        F.struct((F.lit(-1) - F.col("page_id")).alias("id"), F.lit(None).cast("string").alias("file_name"),
                 F.lit(0).alias("width"), F.lit(0).alias("height")))
    documents = p.select(images.alias("images"), F.concat(
        F.lit("/labels/"), host, F.lit("/instances_"), part, F.lit(".json")).alias("source_file"))
    return r.bronze_images(documents)


def raw_games(t: Tables):
    """Orders and their line items as text rows of a games file, some of them broken."""
    against = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("against"))
    both = join_unique(t.orders, against, ["o_orderkey"], "left")
    low = F.col("o_orderpriority") == "5-LOW"
    return both.select(
        F.col("o_orderstatus").alias("sport"), F.col("o_orderkey").cast("string").alias("game_id"),
        F.col("o_custkey").cast("string").alias("team"), F.lit("rest").alias("opponent"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("not a date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("game_date"),
        F.when(low, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("points_for"),
        F.col("against").cast("string").alias("points_against"),
        F.when(low, F.lit("NaN")).otherwise(F.lit(" 1.5 ")).alias("off_efficiency"),
        F.lit("").alias("def_efficiency"))


_TYPED = """
    a AS (SELECT l_orderkey, sum(l_extendedprice) AS against FROM lineitem GROUP BY 1),
    g AS (SELECT o_orderstatus AS sport, CAST(o_orderkey AS VARCHAR) AS game_id,
                 CAST(o_custkey AS VARCHAR) AS team,
                 CASE WHEN o_orderpriority <> '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') END AS game_date,
                 CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS points_for,
                 against AS points_against,
                 CASE WHEN o_orderpriority <> '5-LOW' THEN 1.5::DOUBLE END AS off_efficiency,
                 CAST(NULL AS DOUBLE) AS def_efficiency
          FROM orders LEFT JOIN a ON l_orderkey = o_orderkey)"""


def _shown_games(df):
    return df.select("sport", "game_id", "team", F.date_format("game_date", "yyyy-MM-dd").alias("game_date"),
                     F.round("points_for", 2).alias("points_for"),
                     F.round("points_against", 2).alias("points_against"), "win",
                     "off_efficiency", "def_efficiency")


@query(f"""
    WITH {_TYPED}
    SELECT sport, game_id, team, game_date, round(points_for, 2) AS points_for,
           round(points_against, 2) AS points_against,
           CASE WHEN sport = 'P' THEN CAST(points_for < points_against AS INTEGER)
                ELSE CAST(points_for > points_against AS INTEGER) END AS win,
           off_efficiency, def_efficiency
    FROM g""")
def typed_games(spark, sf):
    """Typed games; in the sport 'P' fewer points win."""
    return _shown_games(r.bronze_games(raw_games(Tables(spark, sf)), lower_is_better=("P",)))


@query(f"""
    WITH {_TYPED}
    SELECT sport, game_id, team, game_date, round(points_for, 2) AS points_for,
           round(points_against, 2) AS points_against,
           CAST(points_for > points_against AS INTEGER) AS win, off_efficiency, def_efficiency
    FROM g WHERE points_for >= 0 AND points_against >= 0""")
def silver_games(spark, sf):
    return _shown_games(r.silver_games(r.bronze_games(raw_games(Tables(spark, sf)))))


_DOCUMENT_RULES = Rules({"known_language": "lang IN ('en', 'fr', 'de')",
                         "enough_text": "n_chars >= 500"})


@query("""SELECT doc_id, lang, n_chars FROM documents
          WHERE lang IN ('en', 'fr', 'de') AND n_chars >= 500""")
def quality_rules(spark, sf):
    return _DOCUMENT_RULES.keep(Tables(spark, sf).documents).select("doc_id", "lang", "n_chars")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'known_language' END,
                                   CASE WHEN n_chars < 500 THEN 'enough_text' END) AS failed
          FROM documents WHERE NOT (lang IN ('en', 'fr', 'de') AND n_chars >= 500)""")
def quarantined_rows(spark, sf):
    out = _DOCUMENT_RULES.quarantine(Tables(spark, sf).documents.select("doc_id", "lang", "n_chars"))
    return out.select("doc_id", F.array_join("failed_rules", ",").alias("failed"))


@query(f"""
    WITH {_TYPED}
    SELECT 'known_language' AS rule, count(*) FILTER (WHERE lang NOT IN ('en', 'fr', 'de')) AS dropped
    FROM documents
    UNION ALL SELECT 'enough_text', count(*) FILTER (WHERE n_chars < 500) FROM documents
    UNION ALL SELECT 'non_negative_score',
        count(*) FILTER (WHERE NOT coalesce(points_for >= 0 AND points_against >= 0, false)) FROM g""")
def rule_drop_counts(spark, sf):
    t = Tables(spark, sf)
    return _DOCUMENT_RULES.drop_counts(t.documents).unionByName(
        GAME_RULES.drop_counts(r.bronze_games(raw_games(t))))


def instances(t: Tables):
    """Line items as instances of the image of their order; whole numbers throughout."""
    return t.lineitem.select(
        pick(SPORT_NAMES, F.col("l_orderkey")).alias("sport"), F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("category_id"),
        (F.col("l_quantity") * F.col("l_suppkey")).alias("bbox_area"),
        F.col("l_quantity").cast("int").alias("num_visible_keypoints"))


_INSTANCES = f"""
    k AS (SELECT {sql_pick(SPORT_NAMES, 'l_orderkey')} AS sport, l_orderkey AS image_id,
                 l_linenumber AS category_id, l_quantity * l_suppkey AS bbox_area,
                 CAST(l_quantity AS INTEGER) AS num_visible_keypoints
          FROM lineitem WHERE l_quantity * l_suppkey > 0 AND l_quantity >= 5)"""


@query(f"""
    WITH {_INSTANCES},
    s AS (SELECT image_id, count(*) AS n, round(avg(num_visible_keypoints), 2) AS v,
                 round(sum(bbox_area), 1) AS b FROM k GROUP BY 1)
    SELECT {sql_pick(SPORT_NAMES, 'o_orderkey')} AS sport, o_orderkey AS image_id,
           o_orderstatus AS split, coalesce(n, 0) AS num_instances,
           coalesce(v, 0.0) AS avg_visible_keypoints, coalesce(b, 0.0) AS total_bbox_area,
           coalesce(v, 0.0) > 0 AS has_pose
    FROM orders LEFT JOIN s ON image_id = o_orderkey""")
def training_manifest(spark, sf):
    t = Tables(spark, sf)
    images = t.orders.select(pick(SPORT_NAMES, F.col("o_orderkey")).alias("sport"),
                             F.col("o_orderkey").alias("image_id"),
                             F.col("o_orderstatus").alias("split"))
    return r.training_manifest(images, r.silver_keypoints(instances(t)))


@query(f"WITH {_INSTANCES} SELECT sport, image_id, category_id, bbox_area, num_visible_keypoints FROM k")
def athlete_projection(spark, sf):
    return r.athlete_metrics(r.silver_keypoints(instances(Tables(spark, sf))))


@query(f"""
    WITH {_INSTANCES}
    SELECT k.sport, k.image_id, k.category_id, bbox_area, num_visible_keypoints,
           c_name AS athlete_id, c_acctbal AS player_rating
    FROM k LEFT JOIN (SELECT o_orderkey, c_name, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey)
      ON o_orderkey = k.image_id AND k.category_id = 1""")
def roster_link(spark, sf):
    """The first position of every order is its customer; other positions are unknown."""
    t = Tables(spark, sf)
    known = join_unique(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, ["c_custkey"],
                        "inner")
    roster = known.select(
        pick(SPORT_NAMES, F.col("o_orderkey")).alias("sport"), F.col("o_orderkey").alias("image_id"),
        F.lit(1).alias("category_id"), F.col("c_name").alias("athlete_id"),
        F.col("c_acctbal").alias("player_rating"))
    return r.athlete_metrics(r.silver_keypoints(instances(t)), roster)


def athletes(t: Tables):
    """Line items with the game, team and season of their order."""
    orders = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("sport"),
        F.col("o_custkey").alias("team"), F.col("o_custkey").alias("athlete_id"),
        F.year("o_orderdate").alias("season"))
    return join_unique(t.lineitem, orders, ["l_orderkey"], "inner").select(
        "sport", "team", "athlete_id", "season", F.col("l_orderkey").alias("game_id"),
        (F.col("l_quantity") * F.col("l_suppkey")).alias("bbox_area"),
        F.col("l_quantity").cast("int").alias("num_visible_keypoints"))


@query(f"""
    WITH s AS (SELECT l_orderkey, count(*) AS n, avg(l_quantity * l_suppkey) AS b, avg(l_quantity) AS v
               FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS game_id, round({_FORM.format(c='o_totalprice')}, 4) AS form_points_for,
           n AS num_athletes, round(b, 6) AS mean_bbox_area, round(v, 6) AS mean_visible_keypoints
    FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def team_strength(spark, sf):
    t = Tables(spark, sf)
    out = r.team_game_features(games(t), strength=r.team_strength(athletes(t)))
    return out.select("game_id", F.round("form_points_for", 4).alias("form_points_for"), "num_athletes",
                      F.round("mean_bbox_area", 6).alias("mean_bbox_area"),
                      F.round("mean_visible_keypoints", 6).alias("mean_visible_keypoints"))


@query("""
    SELECT o_orderstatus AS sport, o_custkey AS athlete_id, CAST(year(o_orderdate) AS INTEGER) AS season,
           count(*) AS num_instances, round(avg(l_quantity * l_suppkey), 6) AS mean_bbox_area,
           CAST(max(l_quantity) AS INTEGER) AS max_visible_keypoints
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def athlete_summary(spark, sf):
    out = r.athlete_summary(athletes(Tables(spark, sf)), "season")
    return out.withColumn("mean_bbox_area", F.round("mean_bbox_area", 6))


_CLASSES = ", ".join(f"('{s}', {i}, '{n}')" for s, spec in SPORTS.items()
                     for i, n in enumerate(spec.classes))
_UNITS = ", ".join(f"('{s}', '{spec.score_unit}')" for s, spec in SPORTS.items())


@query(f"""
    WITH c(sport, category_id, class_name) AS (VALUES {_CLASSES}),
    l AS (SELECT {sql_pick(SPORT_NAMES, 'l_orderkey')} AS sport, l_linenumber AS category_id FROM lineitem)
    SELECT l.sport, l.category_id, class_name, count(*) AS instances
    FROM l LEFT JOIN c ON c.sport = l.sport AND c.category_id = l.category_id GROUP BY ALL""")
def class_names(spark, sf):
    named = name_classes(instances(Tables(spark, sf)).select("sport", "category_id"))
    return named.groupBy("sport", "category_id", "class_name").agg(F.count(F.lit(1)).alias("instances"))


@query(f"""
    WITH u(sport, score_unit) AS (VALUES {_UNITS}),
    s AS (SELECT {sql_pick(SPORT_NAMES, 'l_orderkey')} AS sport, l_suppkey AS team, l_orderkey AS game_id,
                 sum(l_quantity) AS score FROM lineitem GROUP BY ALL)
    SELECT s.*, score_unit FROM s JOIN u USING (sport)""")
def team_score(spark, sf):
    rows = Tables(spark, sf).lineitem.select(
        pick(SPORT_NAMES, F.col("l_orderkey")).alias("sport"), F.col("l_suppkey").alias("team"),
        F.col("l_orderkey").alias("game_id"), "l_quantity")
    return team_scores(rows, "l_quantity")


_EVENTS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{e}') AS {e}" for e in _EVENTS) + " FROM events GROUP BY 1")
def event_counts_per_user(spark, sf):
    return event_counts(Tables(spark, sf).events, ["user_id"], "event_type", _EVENTS)
