"""Queries: pose and box geometry, detection scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.catalog.base import SPORT_NAMES, Tables, pick, query, sql_pick
from fieldmark.functions import geometry as g
from fieldmark.operators import detection as det
from fieldmark.operators import metrics as m
from fieldmark.plans.export import label_lines
from fieldmark.plans.refinement import angle_rows
from fieldmark.registry import (FLIP_INDEX, KEYPOINTS, LANDMARK_INDEX, LIMBS, OKS_SIGMAS, SPORTS,
                                keypoint_index, mirrored_name)

# The first 51 of the 64 numbers of an embedding serve as a pose.
def _pose():
    return F.slice("embedding", 1, 51).cast("array<double>")


_E = "CAST(embedding AS DOUBLE[])"


def poses(t: Tables):
    return t.embeddings.select("vec_id", "label", _pose().alias("pose"),
                               pick(SPORT_NAMES, F.col("label")).alias("sport"))


_POSES = f"p AS (SELECT vec_id, label, {_E} AS e, {sql_pick(SPORT_NAMES, 'label')} AS sport FROM embeddings)"


def _angle_values(mirror: bool) -> str:
    side = mirrored_name if mirror else (lambda n: n)
    return ", ".join(
        f"('{s}', '{a}', {', '.join(str(3 * keypoint_index(side(n)) + 1) for n in tri)})"
        for s, spec in SPORTS.items() for a, tri in spec.angles.items())


_ANGLE_SQL = """
    d AS (SELECT vec_id, p.sport, angle, e[a] - e[v] AS ux, e[a + 1] - e[v + 1] AS uy,
                 e[b] - e[v] AS wx, e[b + 1] - e[v + 1] AS wy
          FROM p JOIN angles ON angles.sport = p.sport{cond})
    SELECT vec_id, sport, angle, round(degrees(acos(greatest(-1, least(1,
           (ux * wx + uy * wy) / (sqrt(ux * ux + uy * uy) * sqrt(wx * wx + wy * wy)))))), 6) AS deg FROM d"""


def _angle_rows(df, **options):
    found = angle_rows(df.withColumnRenamed("pose", "keypoints"), ["vec_id", "sport"], **options)
    return found.withColumn("deg", F.round("deg", 6))


@query(f"WITH {_POSES}, angles(sport, angle, v, a, b) AS (VALUES {_angle_values(False)}),"
       + _ANGLE_SQL.format(cond=""))
def joint_angles(spark, sf):
    return _angle_rows(poses(Tables(spark, sf)))


@query(f"""WITH {_POSES}, r(sport, angle, v, a, b) AS (VALUES {_angle_values(False)}),
    l(sport, angle, v, a, b) AS (VALUES {_angle_values(True)}),
    angles AS (SELECT *, false AS lefty FROM r UNION ALL SELECT *, true FROM l),"""
       + _ANGLE_SQL.format(cond=" AND lefty = (label >= 5)"))
def handed_angles(spark, sf):
    """Poses with a label of 5 or more are left-handed: both sides change places."""
    return _angle_rows(poses(Tables(spark, sf)), left_handed=F.col("label") >= 5)


@query(f"""WITH {_POSES}, s(limb, i, j) AS (VALUES {', '.join(
    f'({n}, {3 * keypoint_index(a) + 1}, {3 * keypoint_index(b) + 1})' for n, (a, b) in enumerate(LIMBS))})
    SELECT vec_id, limb, e[i] AS x1, e[i + 1] AS y1, e[j] AS x2, e[j + 1] AS y2 FROM p, s""")
def limb_segments(spark, sf):
    df = poses(Tables(spark, sf))
    return df.select("vec_id", F.explode(g.limb_segments(F.col("pose"))).alias("s")).select("vec_id", "s.*")


@query(f"""WITH {_POSES}, f(joint, i) AS (VALUES {', '.join(
    f'({n}, {3 * i + 1})' for n, i in enumerate(FLIP_INDEX))})
    SELECT vec_id, joint, 2 - e[i] AS x, e[i + 1] AS y, e[i + 2] AS v FROM p, f""")
def flip_pose(spark, sf):
    flipped = poses(Tables(spark, sf)).select("vec_id", g.flip_pose(F.col("pose"), F.lit(2.0)).alias("q"))
    joints = F.explode(F.array(*[
        F.struct(F.lit(n).alias("joint"), F.get("q", F.lit(3 * n)).alias("x"),
                 F.get("q", F.lit(3 * n + 1)).alias("y"), F.get("q", F.lit(3 * n + 2)).alias("v"))
        for n in range(len(KEYPOINTS))])).alias("j")
    return flipped.select("vec_id", joints).select("vec_id", "j.*")


# The 64 numbers as 32 landmarks of two values.
def _landmarks():
    return F.transform(F.sequence(F.lit(0), F.lit(31)),
                       lambda i: F.slice("embedding", 2 * i + 1, F.lit(2)).cast("array<double>"))


@query(f"""WITH {_POSES}, f(joint, i) AS (VALUES {', '.join(
    f'({n}, {2 * i + 1})' for n, i in enumerate(LANDMARK_INDEX))})
    SELECT vec_id, joint, e[i] AS x, e[i + 1] AS y FROM p, f""")
def project_landmarks(spark, sf):
    df = Tables(spark, sf).embeddings.select("vec_id", g.to_17_points(_landmarks()).alias("q"))
    return df.select("vec_id", F.posexplode("q").alias("joint", "p")).select(
        "vec_id", "joint", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


@query(f"""WITH {_POSES} SELECT vec_id, CAST(len(list_filter(range(17), lambda k: e[3 * k + 3] > 0)) AS INTEGER)
           AS visible FROM p""")
def visible_points(spark, sf):
    return poses(Tables(spark, sf)).select("vec_id", g.visible_points(F.col("pose")).alias("visible"))


# --- boxes --------------------------------------------------------------------

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _d(c: str):
    return F.col(c).cast("double")


def boxes(t: Tables):
    """Two boxes per line item: p, and q moved by discount and tax."""
    return t.lineitem.select(
        *_LINE, F.array(_d("l_partkey"), _d("l_suppkey"), F.col("l_quantity"), _d("l_linenumber")).alias("p"),
        F.array(F.col("l_partkey") + F.col("l_discount") * 100, F.col("l_suppkey") + F.col("l_tax") * 100,
                F.col("l_quantity") - 1, _d("l_linenumber") * 2).alias("q"))


@query(f"""
    WITH b AS (SELECT {', '.join(_LINE)}, l_partkey AS px, l_suppkey AS py, l_quantity AS pw, l_linenumber AS ph,
                      l_partkey + l_discount * 100 AS qx, l_suppkey + l_tax * 100 AS qy,
                      l_quantity - 1 AS qw, l_linenumber * 2 AS qh FROM lineitem),
    i AS (SELECT *, greatest(0, least(px + pw, qx + qw) - greatest(px, qx))
                    * greatest(0, least(py + ph, qy + qh) - greatest(py, qy)) AS common FROM b)
    SELECT {', '.join(_LINE)}, round(CAST(CASE WHEN pw * ph + qw * qh - common > 0
           THEN common / (pw * ph + qw * qh - common) ELSE 0 END AS DOUBLE), 9) AS iou FROM i""")
def box_iou(spark, sf):
    return boxes(Tables(spark, sf)).select(
        *_LINE, F.round(g.box_iou(F.col("p"), F.col("q")), 9).alias("iou"))


@query(f"""
    SELECT {', '.join(_LINE)}, CAST(l_partkey + l_quantity AS DOUBLE) AS x2,
           CAST(l_suppkey + l_linenumber AS DOUBLE) AS y2, l_quantity AS w, CAST(l_linenumber AS DOUBLE) AS h
    FROM lineitem""")
def box_convert(spark, sf):
    corners = g.to_corners(F.col("p"))
    back = g.from_corners(corners)
    return boxes(Tables(spark, sf)).select(
        *_LINE, F.get(corners, F.lit(2)).alias("x2"), F.get(corners, F.lit(3)).alias("y2"),
        F.get(back, F.lit(2)).alias("w"), F.get(back, F.lit(3)).alias("h"))


_SIGMAS = "([" + ", ".join(str(s) for s in OKS_SIGMAS) + "]::DOUBLE[])"


def _oks_sql(p: str, q: str, area: str) -> str:
    term = (f"exp(-(({p}[3*k+1] - {q}[3*k+1]) ** 2 + ({p}[3*k+2] - {q}[3*k+2]) ** 2)"
            f" / (2 * {area} * (2 * {_SIGMAS}[k+1]) ** 2))")
    seen = f"list_filter(range(17), lambda k: {q}[3*k+3] > 0)"
    return f"(list_sum(list_transform({seen}, lambda k: {term})) / len({seen}))"


@query(f"""WITH {_POSES}
    SELECT q.vec_id, round({_oks_sql('a.e', 'q.e', '(1 + q.label)')}, 9) AS oks
    FROM p q JOIN p a ON a.vec_id = q.vec_id + 1""")
def oks_pairs(spark, sf):
    """Similarity of every pose with the next one."""
    df = poses(Tables(spark, sf))
    nxt = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pose").alias("predicted"))
    value = g.pose_similarity(F.col("predicted"), F.col("pose"), 1.0 + F.col("label"))
    return df.join(nxt, "vec_id").select("vec_id", F.round(value, 9).alias("oks"))


@query(f"""WITH {_POSES}, k AS (SELECT unnest(range(21)) AS k)
    SELECT q.label, round(1000 * avg(sqrt((a.e[3*k+1] - q.e[3*k+1]) ** 2 + (a.e[3*k+2] - q.e[3*k+2]) ** 2
                                  + (a.e[3*k+3] - q.e[3*k+3]) ** 2)), 6) AS mpjpe_mm
    FROM p q JOIN p a ON a.vec_id = q.vec_id + 1, k GROUP BY 1""")
def mpjpe(spark, sf):
    """Mean joint distance of every embedding, read as 21 3D joints, to the next one."""
    df = Tables(spark, sf).embeddings.select("vec_id", "label", F.col("embedding").alias("t"))
    nxt = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("t").alias("p"))
    # Whole poses are joined, their joints laid out afterwards.
    joints = F.explode(F.array(*[
        F.struct(*[(F.get(c, F.lit(3 * k + a)).cast("double") * 1000).alias(f"{c}{a}")
                   for c in ("t", "p") for a in range(3)]) for k in range(21)])).alias("j")
    pairs = df.join(nxt, "vec_id").select("label", joints).select("label", "j.*")
    out = m.mean_joint_error(pairs, ["p0", "p1", "p2"], ["t0", "t1", "t2"], ["label"])
    return out.withColumn("mpjpe_mm", F.round("mpjpe_mm", 6))


@query(f"""
    SELECT {sql_pick(SPORT_NAMES, 'l_orderkey')} AS sport, o_orderstatus AS split, l_orderkey AS image_id,
           concat_ws(' ', l_linenumber, printf('%.8f', (l_suppkey + l_quantity / 2) / 640),
                     printf('%.8f', (l_quantity + l_linenumber / 2) / 480),
                     printf('%.8f', l_quantity / 640), printf('%.8f', l_linenumber / 480)) AS line
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def yolo_lines(spark, sf):
    t = Tables(spark, sf)
    images = t.orders.select(pick(SPORT_NAMES, F.col("o_orderkey")).alias("sport"),
                             F.col("o_orderkey").alias("image_id"), F.col("o_orderstatus").alias("split"),
                             F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"),
                             F.lit(640).alias("width"), F.lit(480).alias("height"))
    found = t.lineitem.select(
        pick(SPORT_NAMES, F.col("l_orderkey")).alias("sport"), F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("category_id"),
        F.array(_d("l_suppkey"), F.col("l_quantity"), F.col("l_quantity"), _d("l_linenumber")).alias("bbox"))
    return label_lines(found, images, digits=8).select("sport", "split", "image_id", "line")


# --- detection scoring --------------------------------------------------------

def scored_boxes(t: Tables):
    """Line items as boxes of their order's image; detections are moved by discount and tax."""
    ident = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey",
                        F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    x, y = _d("l_linenumber") * 8, F.col("l_quantity")
    w, h = F.lit(40.0), F.lit(64.0)
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("category_id"),
        ident.alias("id"), F.array(x, y, w, h).alias("truth"),
        F.array(x + F.round(F.col("l_discount") * 100), y + F.round(F.col("l_tax") * 100), w, h).alias("found"),
        F.col("l_extendedprice").alias("score"))
    truths = rows.select("image_id", "category_id", F.col("id").alias("truth_id"),
                         F.col("truth").alias("shape"), F.lit(40.0 * 64.0).alias("area"))
    detections = rows.select("image_id", "category_id", F.col("id").alias("det_id"), "score",
                             F.col("found").alias("shape"))
    return detections, truths


_THRESHOLDS = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in det.THRESHOLDS) + ") th(t)"


def _match_sql(similarity: str, best: int) -> str:
    """SQL after the CTEs dets(image, cat, id, score, shape...) and truths(image, cat, id, ...)."""
    return f"""
    ranked AS (SELECT *, row_number() OVER (PARTITION BY image, cat ORDER BY score DESC, id) AS rank FROM dets
               QUALIFY rank <= {best}),
    pairs AS (SELECT d.image, d.cat, d.rank, t.id AS tid, {similarity} AS sim
              FROM ranked d JOIN truths t ON t.image = d.image AND t.cat = d.cat),
    queues AS (SELECT image, cat, list({{'rank': rank, 'tid': tid, 'sim': sim, 'ranks': []::BIGINT[],
                                         'tids': []::VARCHAR[]}} ORDER BY rank, sim DESC, tid) AS q
               FROM pairs WHERE sim >= 0.5 GROUP BY ALL),
    taken AS (SELECT image, cat, t, list_reduce(q, lambda acc, x: CASE
                  WHEN x.sim >= t AND NOT list_contains(acc.ranks, x.rank) AND NOT list_contains(acc.tids, x.tid)
                  THEN {{'rank': 0::BIGINT, 'tid': '', 'sim': 0::DOUBLE, 'ranks': list_append(acc.ranks, x.rank),
                         'tids': list_append(acc.tids, x.tid)}} ELSE acc END,
                  {{'rank': 0::BIGINT, 'tid': '', 'sim': 0::DOUBLE, 'ranks': []::BIGINT[], 'tids': []::VARCHAR[]}}
              ).ranks AS ranks FROM queues, {_THRESHOLDS}),
    flags AS (SELECT r.image, r.cat, r.id, r.score, th.t,
                     CAST(coalesce(list_contains(k.ranks, r.rank), false) AS INTEGER) AS hit
              FROM ranked r CROSS JOIN {_THRESHOLDS}
              LEFT JOIN taken k ON k.image = r.image AND k.cat = r.cat AND k.t = th.t),
    run AS (SELECT cat, t, hit, score, image, id,
                   sum(hit) OVER w AS hits, count(*) OVER w AS seen FROM flags
            WINDOW w AS (PARTITION BY cat, t ORDER BY score DESC, image, id ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT cat, count(*) AS n FROM truths GROUP BY 1),
    curve AS (SELECT cat, t, hits, n, max(hits / seen) OVER (PARTITION BY cat, t ORDER BY hits
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env
              FROM run JOIN n USING (cat) WHERE hit = 1),
    ap AS (SELECT n.cat, th.t, coalesce((SELECT sum(env) FROM
                  (SELECT (SELECT c.env FROM curve c WHERE c.cat = n.cat AND c.t = th.t AND c.hits * 100 >= k.k * c.n
                           ORDER BY c.hits LIMIT 1) AS env FROM (SELECT unnest(range(101)) AS k) k)) / 101, 0) AS ap
           FROM n CROSS JOIN {_THRESHOLDS})"""


def _match_ctes_boxes() -> str:
    ident = "concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"
    iou = ("(SELECT c / (2 * 2560 - c) FROM (SELECT greatest(0, 40 - abs(d.x - t.x)) "
           "* greatest(0, 64 - abs(d.y - t.y)) AS c))")
    return f"""WITH l AS (SELECT l_orderkey AS image, l_returnflag AS cat, {ident} AS id, l_linenumber * 8.0::DOUBLE AS x,
                      l_quantity AS y, round(l_discount * 100) AS dx, round(l_tax * 100) AS dy,
                      l_extendedprice AS score FROM lineitem),
    dets AS (SELECT image, cat, id, score, x + dx AS x, y + dy AS y FROM l),
    truths AS (SELECT image, cat, id, x, y FROM l),""" + _match_sql(iou, det.BOX_DETECTIONS)


@query(_match_ctes_boxes() + """
    SELECT image AS image_id, cat AS category_id, id AS det_id, CAST(sum(hit) AS BIGINT) AS thresholds_hit
    FROM flags GROUP BY ALL""")
def box_matches(spark, sf):
    """At how many overlap thresholds every detection hits a truth."""
    found = det.match(*scored_boxes(Tables(spark, sf)))
    hits = F.aggregate("hit", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return found.select("image_id", "category_id", "det_id", hits.alias("thresholds_hit"))


@query(_match_ctes_boxes() + """
    SELECT cat AS category_id, t AS threshold, CAST(round(ap, 9) AS DOUBLE) AS ap FROM ap""")
def box_average_precision(spark, sf):
    from fieldmark.session import settle

    detections, truths = scored_boxes(Tables(spark, sf))
    found = settle(det.match(detections, truths), "box-matches")
    return det.average_precision(found, truths).withColumn("ap", F.round("ap", 9))


@query(_match_ctes_boxes() + """
    SELECT round(avg(ap), 9) AS detect_map, round(avg(ap) FILTER (WHERE t = 0.5), 9) AS detect_map50 FROM ap""")
def box_map(spark, sf):
    out = det.box_map(*scored_boxes(Tables(spark, sf)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def scored_poses(t: Tables):
    """Embeddings as poses in the image of their label; detections are shrunk in x."""
    df = t.embeddings.select(F.col("label").alias("image_id"), F.lit(0).alias("category_id"),
                             F.col("vec_id").cast("string").alias("id"), _pose().alias("pose"),
                             F.get("embedding", F.lit(51)).cast("double").alias("score"))
    shrunk = F.transform("pose", lambda v, i: F.when(F.pmod(i, F.lit(3)) == 0, v * 0.5).otherwise(v))
    truths = df.select("image_id", "category_id", F.col("id").alias("truth_id"),
                       F.col("pose").alias("shape"), F.lit(2.0).alias("area"))
    return df.select("image_id", "category_id", F.col("id").alias("det_id"), "score",
                     shrunk.alias("shape")), truths


def _match_ctes_poses() -> str:
    return f"""WITH l AS (SELECT label AS image, 0 AS cat, CAST(vec_id AS VARCHAR) AS id, {_E} AS e FROM embeddings),
    dets AS (SELECT image, cat, id, e[52] AS score,
                    list_transform(e, lambda v, i: CASE WHEN i % 3 = 1 THEN v * 0.5 ELSE v END) AS e FROM l),
    truths AS (SELECT image, cat, id, e FROM l),""" + _match_sql(_oks_sql("d.e", "t.e", "2.0"), det.POSE_DETECTIONS)


@query(_match_ctes_poses() + """
    SELECT round(avg(ap), 9) AS pose_map, round(avg(ap) FILTER (WHERE t = 0.5), 9) AS pose_oks FROM ap""")
def pose_map(spark, sf):
    out = det.pose_map(*scored_poses(Tables(spark, sf)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])
