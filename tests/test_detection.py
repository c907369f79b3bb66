"""Detection scoring against a plain loop written from the published definition."""

import random

import pytest

from fieldmark.operators import detection as det


def _iou(p, q):
    w = max(0, min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]))
    h = max(0, min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]))
    u = p[2] * p[3] + q[2] * q[3] - w * h
    return w * h / u if u > 0 else 0


def _ap(dets, truths, category, t, best):
    flags = []
    for image in {d[0] for d in dets}:
        mine = sorted((d for d in dets if d[0] == image and d[1] == category), key=lambda d: (-d[3], d[2]))[:best]
        free = sorted((g for g in truths if g[0] == image and g[1] == category), key=lambda g: g[2])
        for d in mine:
            near = [(_iou(d[4], g[3]), g) for g in free]
            near = [x for x in near if x[0] >= t]
            if near:
                top = max(near, key=lambda x: x[0])
                free.remove(top[1])
            flags.append((-d[3], d[0], d[2], bool(near)))
    n = sum(g[1] == category for g in truths)
    points, hits = [], 0
    for seen, f in enumerate(sorted(flags), 1):
        hits += f[3]
        points.append((hits, hits / seen))
    total = 0.0
    for k in range(101):
        total += max((p for h, p in points if h * 100 >= k * n), default=0.0)
    return total / 101


@pytest.fixture(scope="module")
def scene(spark):
    rng = random.Random(7)
    truths, dets = [], []
    for i in range(240):
        image = 0 if i % 3 else rng.randrange(1, 12)          # one image holds most of the boxes
        box = [rng.randrange(60), rng.randrange(60), rng.randrange(20, 40), rng.randrange(20, 40)]
        truths.append((image, rng.choice([0, 0, 1]), i, [float(v) for v in box], 1.0))
        for _ in range(rng.randrange(3)):
            moved = [float(v + rng.randrange(-4, 5)) for v in box[:2]] + [float(v) for v in box[2:]]
            dets.append((image, truths[-1][1], len(dets), rng.randrange(20) / 20, moved))
    truths.append((50, 2, 999, [0.0, 0.0, 1.0, 1.0], 1.0))    # a class without detections
    d = spark.createDataFrame(dets, "image_id int, category_id int, det_id int, score double, shape array<double>")
    g = spark.createDataFrame(truths, "image_id int, category_id int, truth_id int, shape array<double>, area double")
    return dets, truths, d.cache(), g.cache()


@pytest.mark.parametrize("best", [100, 8])
@pytest.mark.parametrize("limit", [None, 30])
def test_average_precision(spark, scene, best, limit):
    dets, truths, d, g = scene
    found = det.match(d, g, thresholds=[0.5, 0.75], best=best).cache()
    got = {(r["category_id"], r["threshold"]): r["ap"]
           for r in det.average_precision(found, g, [0.5, 0.75], limit).collect()}
    assert set(got) == {(c, t) for c in (0, 1, 2) for t in (0.5, 0.75)} and got[(2, 0.5)] == 0
    for (c, t), ap in got.items():
        assert abs(ap - _ap(dets, truths, c, t, best)) < 1e-9


def test_hot_image(spark, scene, low_limit):
    _, _, d, g = scene
    hot = sorted(map(str, det.match(d, g).collect()))
    spark.conf.unset("fieldmark.rowsPerTask")
    assert hot == sorted(map(str, det.match(d, g).collect()))


def test_perfect_detections(spark, scene):
    _, _, _, g = scene
    d = g.where("category_id < 2").selectExpr("image_id", "category_id", "truth_id AS det_id", "0.5D AS score", "shape")
    row = det.box_map(d, g.where("category_id < 2"), limit=None).first()
    assert row["detect_map50"] > 0.5


def test_best_is_a_parameter(spark):
    box = [0.0, 0.0, 10.0, 10.0]
    truths = spark.createDataFrame([(1, 1, 1, box, 100.0)], "image_id long, category_id int, truth_id long, shape array<double>, area double")
    found = spark.createDataFrame([(1, 1, 1, 0.9, [50.0, 50.0, 10.0, 10.0]), (1, 1, 2, 0.8, box)],
                                  "image_id long, category_id int, det_id long, score double, shape array<double>")
    assert det.left_out(found, 1).first()["left_out"] == 1
    assert det.left_out(found).first()["left_out"] == 0
    assert det.box_map(found, truths, best=1).first()["detect_map"] == 0
    assert det.box_map(found, truths).first()["detect_map"] > 0


@pytest.mark.parametrize("limit", [None, 100])
def test_a_class_of_many_hits_leaves_few_rows(spark, limit):
    """600 hits on 600 truths: the tasks send one row for each hundredth of the recall and threshold, not one a hit."""
    rng = random.Random(3)
    box = [0.0, 0.0, 10.0, 10.0]
    truths = [(i, 0, 0, box, 1.0) for i in range(600)]
    dets = [(i, 0, 0, rng.randrange(50) / 50, box if rng.random() < 0.8 else [7.0, 7.0, 10.0, 10.0]) for i in range(600)]
    d = spark.createDataFrame(dets, "image_id int, category_id int, det_id int, score double, shape array<double>")
    g = spark.createDataFrame(truths, "image_id int, category_id int, truth_id int, shape array<double>, area double")
    found = det.match(d, g, thresholds=[0.5, 0.75]).cache()
    steps = det.precision_steps(found, g, [0.5, 0.75], limit)
    assert steps.groupBy("category_id", "at").count().where("count > 101").isEmpty()
    for r in det.average_precision(found, g, [0.5, 0.75], limit).collect():
        assert abs(r["ap"] - _ap(dets, truths, 0, r["threshold"], 100)) < 1e-9
