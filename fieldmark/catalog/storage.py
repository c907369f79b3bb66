"""Queries: landing, sinks, partition replacement, incremental streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.catalog.base import SPORT_NAMES, Tables, pick, query, sql_pick
from fieldmark.operators.hotkeys import join_unique
from fieldmark.plans import refinement as r
from fieldmark.registry import SWEEP_LAYERS, create_layers, table_name
from fieldmark.session import scratch_path
from fieldmark.sources import landing, sinks
from fieldmark.streaming import ingest

# --- tables -------------------------------------------------------------------


def _land_customers(spark, sf):
    """Customers through CSV, one segment blank, next to a source that is not there."""
    out = scratch_path(spark, "landing")
    customers = Tables(spark, sf).customer.withColumn(
        "c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    customers.write.option("header", True).csv(f"{out}/staged/customer")

    def write(name, df):
        sinks.replace_path(df, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    status = landing.land_available(spark, {
        "customer": lambda: landing.survey_csv(spark, f"{out}/staged/customer"),
        "absent": lambda: landing.survey_csv(spark, f"{out}/staged/absent"),
    }, write)
    return out, status


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
                 CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE '' END AS c_mktsegment,
                 c_acctbal AS balance FROM customer""")
def csv_landing(spark, sf):
    out, _ = _land_customers(spark, sf)
    landed = spark.read.parquet(f"{out}/customer")
    assert all(t == "string" for _, t in landed.dtypes)
    return landed.withColumn("balance", F.col("c_acctbal").cast("double")).drop("c_acctbal")


@query("""SELECT 'customer' AS dataset, 'landed' AS status, CAST(NULL AS VARCHAR) AS error, count(*) AS rows,
                 5 AS cols FROM customer
          UNION ALL SELECT 'absent', 'skipped', 'AnalysisException', NULL, NULL""")
def ingest_status(spark, sf):
    return _land_customers(spark, sf)[1]


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_type END, '') AS p_type FROM part")
def blank_fill(spark, sf):
    return landing.blank_fill(Tables(spark, sf).part.select(
        "p_partkey", F.when(F.col("p_size") > 25, F.col("p_type")).alias("p_type")))


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def replace_table(spark, sf):
    """A curated table is written, then replaced by a later result."""
    folder = scratch_path(spark, "layers")
    project = folder.rsplit("-", 1)[-1]
    create_layers(spark, project, SWEEP_LAYERS, folder)
    create_layers(spark, project, SWEEP_LAYERS, folder)      # a second call changes nothing
    name = table_name(project, "curated", "by_nation", SWEEP_LAYERS)
    t = Tables(spark, sf)
    sinks.replace_table(t.nation.select("n_name", F.lit(0).cast("long").alias("customers")), name)
    by_nation = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    fresh = by_nation.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    sinks.replace_table(fresh.select("n_name", "customers"), name)
    return spark.table(name)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS o_totalprice,
                 CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS note, o_orderstatus AS sport FROM orders""")
def replace_partition(spark, sf):
    """One slice is replaced by rows with one more column; the other slices stay."""
    path = scratch_path(spark, "slices")
    rows = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("sport"),
                                           "o_orderpriority")
    sinks.replace_slices(rows.drop("o_orderpriority"), path)
    again = rows.where("sport = 'F'").select("o_orderkey", F.lit(0.0).alias("o_totalprice"),
                                             F.col("o_orderpriority").alias("note"), "sport")
    sinks.replace_slices(again, path)
    return sinks.read_slices(spark, path).select("o_orderkey", "o_totalprice", "note", "sport")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def partition_scan(spark, sf):
    """Manifest-like read: sport and split are folders, so other folders are not opened."""
    path = scratch_path(spark, "manifest")
    rows = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("sport"),
                                           F.col("o_orderpriority").alias("split"))
    sinks.replace_path(rows, f"{path}/gold/training_manifest", ["sport", "split"])
    return ingest.manifest(spark, path, "F", "2-HIGH").select("o_orderkey", "o_totalprice")


# --- streams ------------------------------------------------------------------

def stage_labels(t: Tables, root: str, early: bool) -> None:
    """Orders as one-line annotation documents, one folder per sport; `early` ones first."""
    image = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg"))
                     .alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    box = F.struct(
        F.col("o_orderkey").alias("image_id"), F.lit(1).alias("category_id"),
        F.array(F.lit(0.0), F.lit(0.0), F.pmod("o_custkey", F.lit(50)).cast("double"), F.lit(2.0)).alias("bbox"),
        F.lit(None).cast("array<double>").alias("keypoints"),
        F.pmod("o_orderkey", F.lit(18)).cast("int").alias("num_keypoints"))
    first = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    docs = (t.orders.where(first if early else ~first)
            .select(pick(SPORT_NAMES, F.col("o_custkey")).alias("sport"),
                    F.array(image).alias("images"), F.array(box).alias("annotations")))
    for sport in SPORT_NAMES:
        (docs.where(F.col("sport") == sport).drop("sport")
         .write.mode("append").json(f"{root}/labels/{sport}"))


_STREAMED = f"""
    o AS (SELECT {sql_pick(SPORT_NAMES, 'o_custkey')} AS sport, o_orderkey AS image_id,
                 (o_custkey % 50) * 2.0::DOUBLE AS bbox_area,
                 CAST(o_orderkey % 18 AS INTEGER) AS num_visible_keypoints FROM orders)"""


def _ingest_labels(spark, sf) -> tuple[str, str]:
    """Two rounds of files through landing, bronze and silver; a third round finds nothing new."""
    t, root, out = Tables(spark, sf), scratch_path(spark, "files"), scratch_path(spark, "layers")
    steps = ("bronze/images", "bronze/keypoints", "silver/keypoints")
    for early in (True, False):
        stage_labels(t, root, early)
        ingest.land(spark, root, out, ("raw_labels",), multi_line=False)
        ingest.refine(spark, out, steps)
    ingest.land(spark, root, out, ("raw_labels",), multi_line=False)
    ingest.refine(spark, out, steps)
    return root, out


@query(f"WITH {_STREAMED} SELECT sport, image_id, bbox_area, num_visible_keypoints FROM o "
       "WHERE bbox_area > 0 AND num_visible_keypoints >= 5")
def stream_bronze(spark, sf):
    """Silver instances after several incremental runs: each document exactly once."""
    _, out = _ingest_labels(spark, sf)
    return ingest.read_layer(spark, f"{out}/silver/keypoints").select(
        "sport", "image_id", "bbox_area", "num_visible_keypoints")


@query(f"""WITH {_STREAMED}
    SELECT sport, count(*) AS streamed, count(*) AS batched, count(*) AS common FROM o GROUP BY 1""")
def stream_equals_batch(spark, sf):
    """Bronze images from the streams next to the same files read as a batch."""
    root, out = _ingest_labels(spark, sf)
    batch = r.bronze_images(landing.labels(spark, f"{root}/labels", multi_line=False)).select(
        "sport", "image_id", F.lit(1).alias("b"))
    stream = ingest.read_layer(spark, f"{out}/bronze/images").select("sport", "image_id", F.lit(1).alias("s"))
    return (stream.join(batch, ["sport", "image_id"], "full").groupBy("sport")
            .agg(F.count("s").alias("streamed"), F.count("b").alias("batched"),
                 F.count(F.when(F.col("s").isNotNull() & F.col("b").isNotNull(), 1)).alias("common")))


_PAGE_PLACE = "CASE WHEN url LIKE 'https%' THEN 'golf' ELSE 'tennis' END"


@query(f"""
    WITH p AS (SELECT {_PAGE_PLACE} AS sport, html FROM pages)
    SELECT 'frames' AS source, sport, 'train' AS split, CAST(sum(strlen(html) + 1) AS BIGINT) AS bytes,
           CAST(NULL AS DOUBLE) AS total FROM p GROUP BY sport
    UNION ALL
    SELECT 'games', event_type, NULL, count(*), round(sum(value), 6) FROM events GROUP BY event_type""")
def file_streams(spark, sf):
    """Pages as image files and events as game CSV, taken up by streams in several runs."""
    t, root, out = Tables(spark, sf), scratch_path(spark, "files"), scratch_path(spark, "layers")
    pages = t.pages.select(F.expr(_PAGE_PLACE).alias("sport"), "html")
    for sport in ("golf", "tennis"):
        (pages.where(F.col("sport") == sport).select("html")
         .write.text(f"{root}/images/{sport}/train"))
    games = t.events.select(
        F.col("event_id").cast("string").alias("game_id"), F.col("user_id").cast("string").alias("team"),
        F.lit("rest").alias("opponent"), F.date_format("ts", "yyyy-MM-dd").alias("game_date"),
        F.col("value").cast("string").alias("points_for"), F.lit("0").alias("points_against"),
        F.lit(None).cast("string").alias("off_efficiency"), F.lit(None).cast("string").alias("def_efficiency"),
        F.col("event_type").alias("kind"), F.col("event_id").alias("note"))
    # Every second kind has its columns the other way round and one more.
    for i, (kind,) in enumerate(games.select("kind").distinct().orderBy("kind").collect()):
        names = [c for c in games.columns if c != "kind"]
        names = names[::-1] if i % 2 else names[:-1]
        games.where(F.col("kind") == kind).select(*names).write.option("header", True).csv(f"{root}/games/{kind}")
        ingest.land(spark, root, out, ("games",))
    ingest.land(spark, root, out, ("frames",), frame_glob="*.txt")
    ingest.land(spark, root, out, ("frames", "games"), frame_glob="*.txt")
    ingest.refine(spark, out, ("bronze/games", "silver/games"))
    frames = ingest.read_layer(spark, f"{out}/landing/frames").groupBy("sport", "split").agg(
        F.sum("bytes").alias("bytes"))
    played = ingest.read_layer(spark, f"{out}/silver/games").groupBy("sport").agg(
        F.count(F.lit(1)).alias("bytes"), F.round(F.sum("points_for"), 6).alias("total"))
    return (frames.select(F.lit("frames").alias("source"), "sport", "split", "bytes",
                          F.lit(None).cast("double").alias("total"))
            .unionByName(played.select(F.lit("games").alias("source"), "sport",
                                       F.lit(None).cast("string").alias("split"), "bytes", "total")))


@query("""
    WITH i AS (SELECT o_orderstatus AS sport, count(*) AS images FROM orders GROUP BY 1),
    s AS (SELECT o_orderstatus AS sport, count(*) AS posed FROM orders
          WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 5) GROUP BY 1)
    SELECT sport, images, posed FROM i JOIN s USING (sport)""")
def gold_refresh(spark, sf):
    """The manifest is written from part of the instances, then recomputed from all of them."""
    t, path = Tables(spark, sf), scratch_path(spark, "gold")
    images = t.orders.select(F.col("o_orderstatus").alias("sport"), F.col("o_orderkey").alias("image_id"))
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    rows = join_unique(t.lineitem, orders, ["l_orderkey"], "inner").select(
        F.col("o_orderstatus").alias("sport"), F.col("l_orderkey").alias("image_id"),
        F.col("l_quantity").alias("bbox_area"), F.col("l_quantity").cast("int").alias("num_visible_keypoints"),
        "l_linestatus")
    for part in (rows.where("l_linestatus = 'O'"), rows):
        sinks.replace_path(r.training_manifest(images, r.silver_keypoints(part)), path, ["sport"])
    return spark.read.parquet(path).groupBy("sport").agg(
        F.count(F.lit(1)).alias("images"), F.count(F.when(F.col("has_pose"), 1)).alias("posed"))
