"""Raw sports and survey files to features, models and leaderboards, on Spark DataFrames.

The parts most often used from outside; everything else by its module.
"""

from fieldmark.functions.geometry import joint_angle, to_17_points
from fieldmark.operators.classifiers import MODELS
from fieldmark.operators.labels import split_silver, to_silver
from fieldmark.operators.preprocess import fit_preprocess
from fieldmark.operators.reducers import REDUCERS, fit_reducer
from fieldmark.plans.comparison import write_comparison
from fieldmark.plans.grid import SweepConfig, expand_grid
from fieldmark.plans.sweep import refit_best, run_cell, sweep
from fieldmark.plans.targets import score_targets, train_target, train_targets
from fieldmark.registry import DATASETS, SPORTS, TARGETS, VISION_MODELS, specs_for, sport_spec, targets_for
from fieldmark.session import build_session
from fieldmark.streaming.ingest import ingest

__all__ = [
    "DATASETS", "MODELS", "REDUCERS", "SPORTS", "TARGETS", "VISION_MODELS", "SweepConfig",
    "build_session", "expand_grid", "fit_preprocess", "fit_reducer", "ingest", "joint_angle",
    "refit_best", "run_cell", "score_targets", "specs_for", "split_silver", "sport_spec", "sweep",
    "targets_for", "to_17_points", "to_silver", "train_target", "train_targets", "write_comparison",
]
