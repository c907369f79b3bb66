"""Registries: sports, pose layouts, vision models, prediction targets, survey datasets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: COCO person keypoints, index order -------------------------
KEYPOINTS = [
    "nose", "left_eye", "right_eye", "left_ear", "right_ear",
    "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip",
    "left_knee", "right_knee", "left_ankle", "right_ankle",
]

# --- fixed values: COCO keypoint similarity sigmas, same order ----------------
OKS_SIGMAS = [
    0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072,
    0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089,
]

# --- fixed values: limb edges of the 17 point pose ----------------------------
LIMBS = [
    ("left_shoulder", "left_elbow"), ("left_elbow", "left_wrist"),
    ("right_shoulder", "right_elbow"), ("right_elbow", "right_wrist"),
    ("left_hip", "left_knee"), ("left_knee", "left_ankle"),
    ("right_hip", "right_knee"), ("right_knee", "right_ankle"),
    ("left_shoulder", "right_shoulder"), ("left_hip", "right_hip"),
    ("left_shoulder", "left_hip"), ("right_shoulder", "right_hip"),
]

# --- fixed values: 33 landmark layout, index order ----------------------------
LANDMARKS = [
    "nose", "left_eye_inner", "left_eye", "left_eye_outer",
    "right_eye_inner", "right_eye", "right_eye_outer", "left_ear", "right_ear",
    "mouth_left", "mouth_right", "left_shoulder", "right_shoulder",
    "left_elbow", "right_elbow", "left_wrist", "right_wrist",
    "left_pinky", "right_pinky", "left_index", "right_index",
    "left_thumb", "right_thumb", "left_hip", "right_hip",
    "left_knee", "right_knee", "left_ankle", "right_ankle",
    "left_heel", "right_heel", "left_foot_index", "right_foot_index",
]

# --- fixed values: limb edges of the 33 landmark pose -------------------------
LANDMARK_LIMBS = [
    ("left_shoulder", "right_shoulder"),
    ("left_shoulder", "left_elbow"), ("left_elbow", "left_wrist"),
    ("right_shoulder", "right_elbow"), ("right_elbow", "right_wrist"),
    ("left_shoulder", "left_hip"), ("right_shoulder", "right_hip"),
    ("left_hip", "right_hip"),
    ("left_hip", "left_knee"), ("left_knee", "left_ankle"),
    ("right_hip", "right_knee"), ("right_knee", "right_ankle"),
    ("left_ankle", "left_heel"), ("left_heel", "left_foot_index"),
    ("right_ankle", "right_heel"), ("right_heel", "right_foot_index"),
]


def keypoint_index(name: str) -> int:
    return KEYPOINTS.index(name)


def mirrored_name(name: str) -> str:
    """The same body part on the other side."""
    side, _, part = name.partition("_")
    other = {"left": "right", "right": "left"}.get(side)
    return f"{other}_{part}" if other else name


# Positions after a horizontal flip, and the 17 point subset of the 33 landmarks.
FLIP_INDEX = [keypoint_index(mirrored_name(n)) for n in KEYPOINTS]
LANDMARK_INDEX = [LANDMARKS.index(n) for n in KEYPOINTS]


@dataclass(frozen=True)
class Sport:
    key: str
    classes: tuple[str, ...]   # position = category_id
    events: tuple[str, ...]
    angles: dict               # name -> (vertex, a, b)
    score_unit: str


# --- fixed values: the six sports ---------------------------------------------
SPORTS = {
    s.key: s
    for s in [
        Sport("golf",
              ("golfer", "club", "ball"),
              ("address", "backswing", "downswing", "impact", "follow_through"),
              {"lead_arm": ("left_elbow", "left_shoulder", "left_wrist"),
               "trail_arm": ("right_elbow", "right_shoulder", "right_wrist"),
               "lead_knee_flex": ("left_knee", "left_hip", "left_ankle"),
               "spine_tilt": ("left_hip", "left_shoulder", "right_hip"),
               "hip_hinge": ("left_hip", "left_shoulder", "left_knee")},
              "strokes"),
        Sport("football",
              ("player", "football", "goalpost", "pylon"),
              ("snap", "pass", "catch", "run", "tackle"),
              {"throwing_elbow": ("right_elbow", "right_shoulder", "right_wrist"),
               "throwing_shoulder": ("right_shoulder", "right_elbow", "right_hip"),
               "stride_knee": ("left_knee", "left_hip", "left_ankle"),
               "trunk_lean": ("left_hip", "left_shoulder", "right_hip")},
              "points"),
        Sport("basketball",
              ("player", "basketball", "rim", "backboard"),
              ("shot", "layup", "dribble", "rebound", "pass", "block"),
              {"shooting_elbow": ("right_elbow", "right_shoulder", "right_wrist"),
               "release_shoulder": ("right_shoulder", "right_elbow", "right_hip"),
               "knee_bend": ("right_knee", "right_hip", "right_ankle"),
               "trunk_lean": ("left_hip", "left_shoulder", "right_hip")},
              "points"),
        Sport("baseball",
              ("player", "baseball", "bat", "glove", "base"),
              ("pitch", "swing", "hit", "catch", "throw", "steal"),
              {"throwing_elbow": ("right_elbow", "right_shoulder", "right_wrist"),
               "lead_arm": ("left_elbow", "left_shoulder", "left_wrist"),
               "stride_knee": ("left_knee", "left_hip", "left_ankle"),
               "hip_shoulder_sep": ("left_hip", "left_shoulder", "right_hip")},
              "runs"),
        Sport("hockey",
              ("skater", "puck", "stick", "goal_net"),
              ("shot", "pass", "faceoff", "check", "save"),
              {"shot_elbow": ("right_elbow", "right_shoulder", "right_wrist"),
               "skating_knee_flex": ("left_knee", "left_hip", "left_ankle"),
               "forward_lean": ("left_hip", "left_shoulder", "left_knee"),
               "hip_hinge": ("right_hip", "right_shoulder", "right_knee")},
              "goals"),
        Sport("tennis",
              ("player", "tennis_ball", "racket", "net"),
              ("serve", "forehand", "backhand", "volley", "return"),
              {"serve_shoulder": ("right_shoulder", "right_elbow", "right_hip"),
               "swing_elbow": ("right_elbow", "right_shoulder", "right_wrist"),
               "trunk_rotation": ("left_hip", "left_shoulder", "right_hip"),
               "knee_load": ("right_knee", "right_hip", "right_ankle")},
              "points"),
    ]
}


def sport_spec(key: str) -> Sport:
    if key not in SPORTS:
        raise ValueError(f"unknown sport {key!r}; known: {sorted(SPORTS)}")
    return SPORTS[key]


@dataclass(frozen=True)
class VisionModel:
    key: str
    family: str
    task: str
    weights: str
    description: str
    trainable: bool = True


# --- fixed values: model keys, families, tasks and weights --------------------
VISION_MODELS = {
    m.key: m
    for m in [
        VisionModel("yolo_detect", "yolo", "detect", "yolo11n.pt", "one-stage box detector"),
        VisionModel("yolo_pose", "yolo", "pose", "yolo11n-pose.pt", "one-stage pose model"),
        VisionModel("resnet_detect", "resnet", "detect", "fasterrcnn_resnet50_fpn_v2",
                    "two-stage box detector"),
        VisionModel("resnet_pose", "resnet", "pose", "keypointrcnn_resnet50_fpn",
                    "two-stage pose model"),
        VisionModel("fast_rcnn_detect", "resnet", "detect", "fasterrcnn_resnet50_fpn",
                    "two-stage box detector on outside proposals"),
        VisionModel("cnn_detect", "cnn", "detect", "ssdlite320_mobilenet_v3_large",
                    "small one-stage box detector"),
        VisionModel("rtdetr_detect", "detr", "detect", "rtdetr-l.pt", "transformer box detector"),
        VisionModel("rtmpose_pose", "mmpose", "pose", "rtmpose-m", "top-down 2D pose model"),
        VisionModel("blazepose_pose3d", "mediapipe", "pose3d", "pose_landmarker_full.task",
                    "33 landmark 3D pose model, evaluated only", trainable=False),
    ]
}

# --- fixed values: metric columns of a model run, in display order ------------
RUN_METRICS = [
    "detect_map", "detect_map50", "pose_map", "pose_oks", "mpjpe_mm",
    "latency_ms_p50", "latency_ms_p95", "params_millions", "size_mb", "train_seconds",
]


def specs_for(family: str | None = None, task: str | None = None) -> list[VisionModel]:
    """Vision models of a family and/or task; no filter returns all."""
    families = {m.family for m in VISION_MODELS.values()}
    tasks = {m.task for m in VISION_MODELS.values()}
    if family is not None and family not in families:
        raise ValueError(f"unknown family {family!r}")
    if task is not None and task not in tasks:
        raise ValueError(f"unknown task {task!r}")
    return [m for m in VISION_MODELS.values()
            if family in (None, m.family) and task in (None, m.task)]


@dataclass(frozen=True)
class Target:
    key: str
    kind: str            # classification | regression
    scope: str           # team_game | athlete | recruit
    label: str
    feature_table: str
    metric: str
    description: str = ""

    @property
    def entity(self) -> str:
        return "game_id" if self.scope == "team_game" else "athlete_id"


# --- fixed values: prediction targets and row keys ----------------------------
TARGETS = {
    t.key: t
    for t in [
        Target("win_probability", "classification", "team_game", "win",
               "team_game_features", "roc_auc", "chance that the team wins"),
        Target("points_for", "regression", "team_game", "points_for",
               "team_game_features", "rmse", "team score"),
        Target("points_against", "regression", "team_game", "points_against",
               "team_game_features", "rmse", "opponent score"),
        Target("off_efficiency", "regression", "team_game", "off_efficiency",
               "team_game_features", "rmse", "attack efficiency"),
        Target("def_efficiency", "regression", "team_game", "def_efficiency",
               "team_game_features", "rmse", "defence efficiency"),
        Target("player_index", "regression", "athlete", "player_rating",
               "athlete_metrics", "rmse", "athlete performance index"),
        Target("scholarship_roi", "regression", "recruit", "roi",
               "athlete_metrics", "rmse", "athlete contribution against cost"),
    ]
}
KEY_COLUMNS = {"sport", "team", "opponent", "game_id", "game_date", "athlete_id",
               "recruit_id", "season"}


def targets_for(scope: str | None = None) -> list[Target]:
    scopes = {t.scope for t in TARGETS.values()}
    if scope is not None and scope not in scopes:
        raise ValueError(f"unknown scope {scope!r}")
    return [t for t in TARGETS.values() if scope in (None, t.scope)]


@dataclass(frozen=True)
class Dataset:
    name: str
    target: tuple[str, ...]            # the first one present is used
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    target_kind: str = "binarize_median"   # or label_equals
    positive_label: str | None = None
    filters: dict = field(default_factory=dict)
    sentinel_min: float = 9_999_990.0


# --- fixed values: survey datasets, their columns and filters -----------------
DATASETS = {
    d.name: d
    for d in [
        Dataset("nscg_2023", ("SALARY",), ("AGE", "HRSWK", "WKSWK"),
                ("SEX_2023", "RACECAT", "HISPANIC", "MARSTA", "CTZUSIN", "BTHUS",
                 "DGRDG", "MRDG", "BADG", "N2BAMED", "HDCRN21C", "BACRN21C",
                 "EMSECSM", "EMSIZE", "EMTP", "N2OCPRMG",
                 "JOBSATIS", "SATADV", "SATSAL", "SATSEC",
                 "ACTMGT", "ACTRD", "ACTTCH", "ACTCAP"),
                filters={"LFSTAT": ("1",)}),
        Dataset("scorecard_2026", ("MD_EARN_WNE_P10", "MD_EARN_WNE_P6", "MN_EARN_WNE_P10"),
                ("ADM_RATE", "SAT_AVG", "ACTCMMID", "UGDS", "COSTT4_A",
                 "TUITIONFEE_IN", "TUITIONFEE_OUT", "PCTPELL", "C150_4",
                 "UGDS_WHITE", "UGDS_BLACK", "UGDS_HISP", "UGDS_ASIAN"),
                ("CONTROL", "REGION", "LOCALE", "PREDDEG", "HIGHDEG", "CCSIZSET", "STABBR")),
        Dataset("acs_co_2024", ("WAGP",), ("AGEP", "WKHP"),
                ("SCHL", "FOD1P", "OCCP", "SEX", "RAC1P", "MAR", "CIT", "COW", "HISP"),
                filters={"SCHL": ("21", "22", "23", "24"), "ESR": ("1", "2")}),
        Dataset("pisa_2022", ("BSMJ", "PV1MATH"),
                ("ESCS", "HOMEPOS", "HISCED", "BMMJ1", "BFMJ2", "PV1MATH", "PV1READ",
                 "PV1SCIE", "BELONG", "GROSAGR", "WORKMAST"),
                ("ST004D01T", "IMMIG", "GRADE", "REPEAT", "CNT")),
    ]
}

# --- fixed values: layers of the two projects ---------------------------------
REFINEMENT_LAYERS = {"landing": "00_landing", "bronze": "01_bronze",
                     "silver": "02_silver", "gold": "03_gold"}
SWEEP_LAYERS = {"landing": "00_landing", "cleansed": "01_cleansed", "curated": "02_curated"}


def layer_schema(project: str, layer: str, layers: dict = REFINEMENT_LAYERS) -> str:
    return f"{project}_{layers[layer]}"


def table_name(project: str, layer: str, name: str, layers: dict = REFINEMENT_LAYERS,
               catalog: str | None = None) -> str:
    """Back-quoted table name; with a catalog the name has three parts."""
    parts = ([catalog] if catalog else []) + [layer_schema(project, layer, layers), name]
    return ".".join(f"`{p}`" for p in parts)


def create_layers(spark: SparkSession, project: str, layers: dict = REFINEMENT_LAYERS,
                  location: str | None = None) -> list[str]:
    """Create every layer schema that does not exist yet."""
    names = []
    for layer in layers:
        schema = layer_schema(project, layer, layers)
        at = f" LOCATION '{location}/{schema}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`{at}")
        names.append(schema)
    return names


# Registries as small DataFrames, to be joined (their size is that of the code above).

def models_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m.key, m.family, m.task, m.description) for m in VISION_MODELS.values()],
        "model_key string, family string, task string, description string")


def classes_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s.key, i, name) for s in SPORTS.values() for i, name in enumerate(s.classes)],
        "sport string, category_id int, class_name string")


def sports_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.key, s.score_unit) for s in SPORTS.values()],
                                 "sport string, score_unit string")


def angles_frame(spark: SparkSession) -> DataFrame:
    rows = [(s.key, a, *(keypoint_index(n) for n in triple))
            for s in SPORTS.values() for a, triple in s.angles.items()]
    return spark.createDataFrame(
        rows, "sport string, angle string, vertex int, a int, b int")


def comparison_schema() -> T.StructType:
    ids = ["sport", "model_key", "family", "task", "description", "run_id"]
    return T.StructType([T.StructField(c, T.StringType()) for c in ids]
                        + [T.StructField(c, T.DoubleType()) for c in RUN_METRICS])
