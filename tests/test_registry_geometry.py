import json

import pytest
from pyspark.sql import functions as F

from fieldmark import registry as reg
from fieldmark.functions import geometry as g


def test_layouts():
    assert len(reg.KEYPOINTS) == len(reg.OKS_SIGMAS) == 17 and len(reg.LANDMARKS) == 33
    assert [reg.LANDMARKS[i] for i in reg.LANDMARK_INDEX] == reg.KEYPOINTS
    assert all(a in reg.KEYPOINTS and b in reg.KEYPOINTS and a != b for a, b in reg.LIMBS)
    assert all(a in reg.LANDMARKS and b in reg.LANDMARKS for a, b in reg.LANDMARK_LIMBS)
    assert [reg.FLIP_INDEX[i] for i in reg.FLIP_INDEX] == list(range(17))


def test_sports():
    assert len(reg.SPORTS) == 6 and sum(len(s.angles) for s in reg.SPORTS.values()) == 25
    assert all(n in reg.KEYPOINTS for s in reg.SPORTS.values() for t in s.angles.values() for n in t)
    assert reg.sport_spec("golf").score_unit == "strokes"
    with pytest.raises(ValueError):
        reg.sport_spec("chess")


def test_filters():
    assert len(reg.specs_for()) == 9 and len(reg.specs_for(task="pose")) == 3
    assert [m.key for m in reg.specs_for("resnet", "pose")] == ["resnet_pose"]
    assert len(reg.targets_for()) == 7 and len(reg.targets_for("team_game")) == 5
    for call in (lambda: reg.specs_for(family="x"), lambda: reg.targets_for("x")):
        with pytest.raises(ValueError):
            call()


def test_names(spark):
    assert reg.table_name("p", "gold", "t") == "`p_03_gold`.`t`"
    assert reg.table_name("p", "curated", "t", reg.SWEEP_LAYERS, "c") == "`c`.`p_02_curated`.`t`"
    made = reg.create_layers(spark, "proj")
    assert made == reg.create_layers(spark, "proj")
    assert {r[0] for r in spark.sql("SHOW DATABASES").collect()} >= set(made)


def _pose(spark, **points):
    flat = [0.0] * 51
    for name, (x, y, v) in points.items():
        i = 3 * reg.keypoint_index(name)
        flat[i:i + 3] = [x, y, v]
    return spark.createDataFrame([(flat,)], "p array<double>")


def test_joint_angle(spark):
    df = _pose(spark, left_elbow=(1.0, 1.0, 2.0), left_shoulder=(1.0, 2.0, 2.0), left_wrist=(2.0, 1.0, 0.5))
    arm = ("left_elbow", "left_shoulder", "left_wrist")
    row = df.select(g.joint_angle(F.col("p"), *arm).alias("a"),
                    g.joint_angle(F.col("p"), *arm, min_visibility=0.6).alias("hidden"),
                    g.joint_angle(F.col("p"), "nose", "left_eye", "right_eye").alias("flat"),
                    g.visible_points(F.col("p")).alias("seen")).first()
    assert abs(row["a"] - 90) < 1e-9 and row["hidden"] is None and row["flat"] is None and row["seen"] == 3


def test_angle_of_a_straight_limb_is_clipped(spark):
    df = _pose(spark, left_elbow=(0.1, 0.1, 1.0), left_shoulder=(0.3, 0.3, 1.0), left_wrist=(0.7, 0.7, 1.0))
    deg = df.select(g.joint_angle(F.col("p"), "left_elbow", "left_shoulder", "left_wrist")).first()[0]
    assert abs(deg) < 1e-5


def test_mirrored_angles(spark):
    df = _pose(spark, right_elbow=(1.0, 1.0, 1.0), right_shoulder=(1.0, 2.0, 1.0), right_wrist=(2.0, 1.0, 1.0))
    both = df.select(g.sport_angles(F.col("p"), F.lit("golf"), F.lit(True)).alias("l"),
                     g.sport_angles(F.col("p"), F.lit("golf")).alias("r")).first()
    assert abs({a["angle"]: a["deg"] for a in both["l"]}["lead_arm"] - 90) < 1e-9
    assert {a["angle"]: a["deg"] for a in both["r"]}["lead_arm"] is None
    named = df.select(*[c.alias(n) for n, c in g.angle_columns(F.col("p"), "golf").items()]).first()
    assert abs(named["trail_arm"] - 90) < 1e-9


def test_boxes(spark):
    df = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 2.0, 2.0], [0.0, 0.0, 0.0, 0.0], [])],
                               "p array<double>, q array<double>, z array<double>, e array<double>")
    row = df.select(g.box_iou(F.col("p"), F.col("q")).alias("pq"), g.box_iou(F.col("p"), F.col("p")).alias("pp"),
                    g.box_iou(F.col("z"), F.col("z")).alias("zz"), g.box_area(F.col("e")).alias("e"),
                    g.from_corners(g.to_corners(F.col("q"))).alias("q")).first()
    assert abs(row["pq"] - 1 / 7) < 1e-12 and row["pp"] == 1 and row["zz"] == 0 and row["e"] is None
    assert row["q"] == [1, 1, 2, 2]


def test_pose_similarity(spark):
    df = _pose(spark, nose=(1.0, 1.0, 1.0))
    row = df.select(g.pose_similarity(F.col("p"), F.col("p"), F.lit(4.0)).alias("same"),
                    g.pose_similarity(F.col("p"), F.array_repeat(F.lit(0.0), 51), F.lit(4.0)).alias("unseen")).first()
    assert row["same"] == 1 and row["unseen"] is None


def test_label_line_and_description(spark):
    df = spark.createDataFrame([([10.0, 20.0, 20.0, 40.0],)], "b array<double>")
    line = df.select(g.label_line(F.lit(1), F.col("b"), F.lit(100), F.lit(200))).first()[0]
    assert line == "1 0.200000 0.200000 0.200000 0.200000"
    posed = df.select(g.label_line(F.lit(1), F.col("b"), F.lit(100), F.lit(200),
                                   F.array_repeat(F.lit(1.0), 51))).first()[0]
    assert len(posed.split()) == 5 + 51 and posed.endswith("0.010000 0.005000 1")
    d = g.dataset_description("golf", "/r")
    assert json.loads(json.dumps(d))["kpt_shape"] == [17, 3] and d["names"][0] == "golfer"
    assert "flip_idx" not in g.dataset_description("golf", "/r", keypoints=False)


def test_landmark_segments(spark):
    df = spark.createDataFrame([([[float(i), 0.0, 1.0] for i in range(33)],)], "l array<array<double>>")
    row = df.select(g.landmark_segments(F.col("l")).alias("s"), g.to_17_points(F.col("l")).alias("q")).first()
    assert len(row["s"]) == 16 and [p[0] for p in row["q"]] == reg.LANDMARK_INDEX
