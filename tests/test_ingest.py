"""Real files through landing, bronze, silver and gold; sinks."""

import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fieldmark.operators.quality import KEYPOINT_RULES
from fieldmark.plans import refinement as r
from fieldmark.plans.export import export_lines, label_lines
from fieldmark.sources import landing, sinks
from fieldmark.streaming import ingest


def _annotation(image, keypoints=None, n=None, bbox=(1.0, 1.0, 4.0, 5.0)):
    out = {"image_id": image, "category_id": 0, "bbox": None if bbox is None else list(bbox)}
    if keypoints is not None:
        out |= {"keypoints": keypoints, "num_keypoints": n}
    return out


def _image(i):
    return {"id": i, "file_name": f"{i}.jpg", "width": 640, "height": 480}


POSE = [1.0, 2.0, 2.0] * 17


def _stage(root):
    def put(path, content):
        path = os.path.join(root, path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb" if isinstance(content, bytes) else "w") as f:
            f.write(content)

    def doc(images, annotations):
        return json.dumps({"images": images, "annotations": annotations}, indent=1)

    put("labels/golf/person_keypoints_train.json", doc(
        [_image(1), _image(2)],
        [_annotation(1, POSE, 5), _annotation(1, POSE, 4), _annotation(1, POSE, 17, bbox=(0, 0, 0, 9)),
         _annotation(2, POSE, 17, bbox=None), _annotation(1, POSE, 8)]))
    put("labels/golf/instances_train.json", doc([_image(1), _image(2)], [_annotation(2)]))
    put("labels/tennis/person_keypoints_val.json", doc([_image(1)], []))
    put("labels/tennis/notes.json", doc([_image(9)], []))          # no split in its name
    put("images/golf/train/1.jpg", b"12345")
    put("images/golf/train/readme.txt", b"x")
    head = "game_id,team,opponent,game_date,points_for,points_against,off_efficiency,def_efficiency\n"
    put("games/golf/a.csv", head + "g1,A,B,2024-01-01,3,3,1.5,\ng2,A,B,2024-01-02,5,3,x,2\n"
        "g3,A,B,2024-01-02,-1,3,,\ng4,A,B,bad,2,n/a,,\ng5,A,B,2024-01-03,1,,,\ng6,A,B,2024-01-04,9,0,,\n")
    return put, head


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    root, out = str(tmp_path_factory.mktemp("files")), str(tmp_path_factory.mktemp("layers"))
    put, head = _stage(root)
    ingest.ingest(spark, root, out)
    return root, out, put, head


def test_bronze(spark, layers):
    _, out, *_ = layers
    images = ingest.read_layer(spark, f"{out}/bronze/images")
    places = {(x["sport"], x["split"]): x["count"] for x in images.groupBy("sport", "split").count().collect()}
    assert places == {("golf", "train"): 4, ("tennis", "val"): 1, ("tennis", ""): 1}
    assert ingest.read_layer(spark, f"{out}/silver/images").count() == 5
    kp = ingest.read_layer(spark, f"{out}/bronze/keypoints")
    assert kp.count() == 6 and kp.where("num_visible_keypoints = 0").count() == 1
    assert r.check_visible(kp.where("keypoints IS NOT NULL")).where("counted_visible <> 17").count() == 0
    frames = ingest.read_layer(spark, f"{out}/landing/frames").collect()
    assert [(f["sport"], f["split"], f["bytes"]) for f in frames] == [("golf", "train", 5)]


def test_silver_rules(spark, layers):
    _, out, *_ = layers
    kp = ingest.read_layer(spark, f"{out}/silver/keypoints")
    assert sorted(x["num_visible_keypoints"] for x in kp.collect()) == [5, 8]
    bronze = ingest.read_layer(spark, f"{out}/bronze/keypoints")
    seen = Observation()
    KEYPOINT_RULES.observe(bronze, seen).count()
    assert seen.get["rows_in"] == 6 and seen.get["rows_kept"] == 2
    counted = {x["rule"]: x["dropped"] for x in KEYPOINT_RULES.drop_counts(bronze).collect()}
    assert counted == {"has_bbox_area": 2, "enough_visible_keypoints": 2}
    assert KEYPOINT_RULES.quarantine(bronze).count() == 4


def test_games(spark, layers):
    _, out, *_ = layers
    bronze = {x["game_id"]: x for x in ingest.read_layer(spark, f"{out}/bronze/games").collect()}
    assert [bronze[g]["win"] for g in ("g1", "g2", "g4", "g5")] == [0, 1, None, None]
    assert bronze["g4"]["game_date"] is None and bronze["g2"]["off_efficiency"] is None
    silver = ingest.read_layer(spark, f"{out}/silver/games")
    assert sorted(x["game_id"] for x in silver.collect()) == ["g1", "g2", "g6"]
    form = {x["game_id"]: x for x in ingest.read_layer(spark, f"{out}/gold/team_game_features").collect()}
    assert form["g1"]["form_points_for"] is None and form["g2"]["form_points_for"] == 3
    assert form["g6"]["form_points_for"] == 4 and form["g6"]["form_win_rate"] == 0.5


def test_gold_manifest(spark, layers):
    _, out, *_ = layers
    rows = ingest.manifest(spark, out, "golf", "train").collect()
    assert len(rows) == 4        # both label files list the images
    one = next(x for x in rows if x["image_id"] == 1)
    assert (one["num_instances"], one["avg_visible_keypoints"], one["total_bbox_area"], one["has_pose"]) \
        == (2, 6.5, 40.0, True)
    two = next(x for x in rows if x["image_id"] == 2)
    assert two["num_instances"] == 0 and two["has_pose"] is False
    images, kp = (ingest.read_layer(spark, f"{out}/silver/{n}") for n in ("images", "keypoints"))
    assert r.training_manifest(images, kp, dedupe_images=True).where("sport = 'golf'").count() == 2
    labelled = r.bronze_keypoints(ingest.read_layer(spark, f"{out}/landing/raw_labels"), with_split=True)
    assert r.training_manifest(images, labelled, by_split=True).where("num_instances > 0").count() == 4


def test_second_run_adds_only_what_is_new(spark, layers):
    root, out, put, head = layers
    before = ingest.read_layer(spark, f"{out}/silver/games").count()
    ingest.ingest(spark, root, out)
    assert ingest.read_layer(spark, f"{out}/silver/games").count() == before
    put("games/golf/late.csv", head + "g0,A,B,2023-12-31,7,1,,\n")
    ingest.ingest(spark, root, out)
    assert ingest.read_layer(spark, f"{out}/silver/games").count() == before + 1
    form = {x["game_id"]: x for x in ingest.read_layer(spark, f"{out}/gold/team_game_features").collect()}
    assert form["g1"]["form_points_for"] == 7       # the late game changed a later row


def test_athlete_metrics_with_angles(spark, layers):
    _, out, *_ = layers
    kp = ingest.read_layer(spark, f"{out}/silver/keypoints")
    roster = spark.createDataFrame([("golf", 1, 0, "ann")], "sport string, image_id long, category_id int, athlete_id string")
    rows = r.athlete_metrics(kp, roster, angles=True).collect()
    assert {x["athlete_id"] for x in rows} == {"ann"} and all(len(x["angles"]) == 5 for x in rows)


def test_export(spark, layers, tmp_path):
    _, out, *_ = layers
    images = ingest.read_layer(spark, f"{out}/silver/images").dropDuplicates(["sport", "image_id"])
    lines = label_lines(ingest.read_layer(spark, f"{out}/silver/keypoints"), images, with_pose=True)
    assert all(len(x["line"].split()) == 56 for x in lines.collect())
    path = export_lines(lines, str(tmp_path / "out"))
    assert spark.read.text(path).where("sport = 'golf' AND split = 'train' AND image_id = 1").count() == 2


def test_lower_is_better(spark):
    df = spark.createDataFrame([("golf", "g", "A", "B", "2024-01-01", "70", "72", "", "")],
                               "sport string, game_id string, team string, opponent string, game_date string, "
                               "points_for string, points_against string, off_efficiency string, def_efficiency string")
    assert r.bronze_games(df).first()["win"] == 0
    assert r.bronze_games(df, lower_is_better=("golf",)).first()["win"] == 1


def test_replace_slices(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("golf", 1), ("tennis", 2)], "sport string, x int")
    sinks.replace_slices(rows, path)
    sinks.replace_slices(rows.where("sport = 'golf'").withColumns({"x": F.lit(5), "y": F.lit(1)}), path)
    got = {(x["sport"], x["x"], x["y"]) for x in sinks.read_slices(spark, path).collect()}
    assert got == {("golf", 5, 1), ("tennis", 2, None)}
    with pytest.raises(RuntimeError):
        sinks.replace_slices(rows.where("x > 9"), path)


def test_batch_and_stream_readers_agree(spark, layers):
    root, out, *_ = layers
    batch = r.bronze_images(landing.labels(spark, f"{root}/labels")).drop("ingested_at")
    stream = ingest.read_layer(spark, f"{out}/bronze/images")
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_games_go_by_header(spark, tmp_path):
    (tmp_path / "games/golf").mkdir(parents=True)
    (tmp_path / "games/golf/a.csv").write_text("team,weather,points_against,game_id,points_for\nA,rain,1,g1,3\n")
    (tmp_path / "games/golf/b.csv").write_text("game_id,team,points_for,points_against\ng1,B,1,3\n")
    rows = {x["team"]: x for x in landing.games(spark, str(tmp_path)).collect()}
    assert [(rows[t]["game_id"], rows[t]["points_for"], rows[t]["points_against"], rows[t]["opponent"]) for t in "AB"] == [
        ("g1", "3", "1", None), ("g1", "1", "3", None)]
    assert '"weather":"rain"' in rows["A"]["record"] and rows["A"]["sport"] == "golf"


def test_games_stay_text(spark, tmp_path):
    (tmp_path / "games/golf").mkdir(parents=True)
    (tmp_path / "games/golf/a.csv").write_text('game_id,points_for,points_against,team,note,note\n0022300001,05,3\n7,1.50,3,"a, ""b""",1e5,\n'
                                               '007,,"",c\\d,"x\\"y",2,more\n')
    (tmp_path / "games/golf/b.csv").write_text("points_against,game_id\n3,007\n")
    rows = sorted(landing.games(spark, str(tmp_path)).collect(), key=lambda x: (x["game_id"], str(x["record"])))
    assert [(x["game_id"], x["points_for"], x["points_against"], x["team"]) for x in rows] == [
        ("0022300001", "05", "3", None), ("007", None, "", "c\\d"), ("007", None, "3", None), ("7", "1.50", "3", 'a, "b"')]
    records = [{k: v for k, v in json.loads(x["record"]).items() if v is not None} for x in rows]
    assert records[0] == {"game_id": "0022300001", "points_for": "05", "points_against": "3"}
    assert records[1]["note"] == 'x"y' and records[1]["note_5"] == "2" and records[1]["_c6"] == "more"
    assert records[3]["note"] == "1e5"


def test_labels_keep_undeclared_fields(spark, tmp_path):
    doc = {"images": [{"id": 1, "license": 4}], "annotations": [], "info": {"year": "017"}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([doc, doc]))
    (tmp_path / "c.json").write_text(" \n")
    rows = landing.labels(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and all(x["images"][0]["id"] == 1 for x in rows)
    assert sorted(x["raw"] for x in rows) == sorted([json.dumps(doc, indent=1), *[json.dumps([doc, doc])] * 2])
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/a.json").write_text(json.dumps(doc) + "\n\n{broken\n")
    rows = landing.labels(spark, str(tmp_path / "lines"), multi_line=False).collect()
    assert {x["raw"] for x in rows} == {json.dumps(doc), "{broken"}
