"""Pose and box geometry as column expressions.

A pose is a flat array [x1, y1, v1, ..., x17, y17, v17], a box [x, y, w, h].
Sums over the 17 points are written out term by term, so that they stay inside
generated code; array lambdas would leave it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.registry import (FLIP_INDEX, KEYPOINTS, LANDMARK_INDEX, LANDMARK_LIMBS, LANDMARKS,
                                LIMBS, OKS_SIGMAS, SPORTS, keypoint_index, mirrored_name)


def _num(array: Column, i: int) -> Column:
    return F.get(array, F.lit(i)).cast("double")


def point(pose: Column, name: str) -> tuple[Column, Column, Column]:
    i = 3 * keypoint_index(name)
    return _num(pose, i), _num(pose, i + 1), _num(pose, i + 2)


def _point_at(pose: Column, index: Column) -> tuple[Column, Column, Column]:
    return tuple(F.get(pose, index * 3 + k).cast("double") for k in range(3))


def _angle(v, a, b, min_visibility: float | None) -> Column:
    (vx, vy, vv), (ax, ay, av), (bx, by, bv) = v, a, b
    ux, uy, wx, wy = ax - vx, ay - vy, bx - vx, by - vy
    length = F.sqrt(ux * ux + uy * uy) * F.sqrt(wx * wx + wy * wy)
    cos = (ux * wx + uy * wy) / length
    ok = length > 0
    if min_visibility is not None:
        ok = ok & (F.least(vv, av, bv) >= F.lit(min_visibility))
    return F.when(ok, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def joint_angle(pose: Column, vertex: str, a: str, b: str,
                min_visibility: float | None = None) -> Column:
    """Degrees at `vertex` between the directions to `a` and `b`.

    NULL where a side has no length and, if asked, where a point is less visible
    than `min_visibility`.
    """
    return _angle(*(point(pose, n) for n in (vertex, a, b)), min_visibility)


def angle_triples(sport: Column, left_handed: Column | None = None) -> Column:
    """array<struct<angle, vertex, a, b>> of the sport's angles, as point positions.

    For left-handed athletes both sides change places.
    """
    def of(spec, mirror: bool) -> Column:
        side = mirrored_name if mirror else (lambda n: n)
        return F.array(*[
            F.struct(F.lit(name).alias("angle"),
                     *[F.lit(keypoint_index(side(n))).alias(k) for k, n in zip(("vertex", "a", "b"), tri)])
            for name, tri in spec.angles.items()])

    out = None
    for key, spec in SPORTS.items():
        value = of(spec, False)
        if left_handed is not None:
            value = F.when(left_handed, of(spec, True)).otherwise(value)
        out = F.when(sport == key, value) if out is None else out.when(sport == key, value)
    return out


def triple_angle(pose: Column, triple: Column, min_visibility: float | None = None) -> Column:
    """The angle of one entry of angle_triples."""
    return _angle(*(_point_at(pose, triple[k]) for k in ("vertex", "a", "b")), min_visibility)


def sport_angles(pose: Column, sport: Column, left_handed: Column | None = None,
                 min_visibility: float | None = None) -> Column:
    """array<struct<angle, deg>> with the angles of the row's sport."""
    return F.transform(angle_triples(sport, left_handed), lambda t: F.struct(
        t["angle"].alias("angle"), triple_angle(pose, t, min_visibility).alias("deg")))


def angle_columns(pose: Column, sport: str, min_visibility: float | None = None) -> dict:
    """The angles of one sport, as name -> column."""
    return {name: joint_angle(pose, *triple, min_visibility=min_visibility)
            for name, triple in SPORTS[sport].angles.items()}


def limb_segments(pose: Column) -> Column:
    """array<struct<limb, x1, y1, x2, y2>>, one per edge of the 17 point pose."""
    out = []
    for n, (a, b) in enumerate(LIMBS):
        (x1, y1, _), (x2, y2, _) = point(pose, a), point(pose, b)
        out.append(F.struct(F.lit(n).alias("limb"), x1.alias("x1"), y1.alias("y1"),
                            x2.alias("x2"), y2.alias("y2")))
    return F.array(*out)


def landmark_segments(landmarks: Column) -> Column:
    """The same for array<array<double>> landmarks (33 of them)."""
    out = []
    for n, (a, b) in enumerate(LANDMARK_LIMBS):
        p, q = (F.get(landmarks, F.lit(LANDMARKS.index(k))) for k in (a, b))
        out.append(F.struct(F.lit(n).alias("limb"), _num(p, 0).alias("x1"), _num(p, 1).alias("y1"),
                            _num(q, 0).alias("x2"), _num(q, 1).alias("y2")))
    return F.array(*out)


def to_17_points(landmarks: Column) -> Column:
    """The 17 of 33 landmarks that make up the common pose, in its order."""
    return F.array(*[F.get(landmarks, F.lit(i)) for i in LANDMARK_INDEX])


def flip_pose(pose: Column, width: Column) -> Column:
    """Mirror a pose in an image of the given width; sides change places."""
    flat = []
    for source in FLIP_INDEX:
        x, y, v = (_num(pose, 3 * source + k) for k in range(3))
        flat += [width - x, y, v]
    return F.array(*flat)


def visible_points(pose: Column) -> Column:
    flags = [F.when(_num(pose, 3 * i + 2) > 0, 1).otherwise(0) for i in range(len(KEYPOINTS))]
    return reduce(lambda p, q: p + q, flags)


def box_area(box: Column) -> Column:
    return _num(box, 2) * _num(box, 3)


def to_corners(box: Column) -> Column:
    x, y, w, h = (_num(box, i) for i in range(4))
    return F.array(x, y, x + w, y + h)


def from_corners(corners: Column) -> Column:
    x1, y1, x2, y2 = (_num(corners, i) for i in range(4))
    return F.array(x1, y1, x2 - x1, y2 - y1)


def box_iou(p: Column, q: Column) -> Column:
    """Overlap area over joint area; 0 where the joint area is 0."""
    px, py, pw, ph = (_num(p, i) for i in range(4))
    qx, qy, qw, qh = (_num(q, i) for i in range(4))
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(px + pw, qx + qw) - F.greatest(px, qx))
    h = F.greatest(zero, F.least(py + ph, qy + qh) - F.greatest(py, qy))
    # No CASE around it: what occurs twice is then computed once.
    return F.coalesce(F.try_divide(w * h, pw * ph + qw * qh - w * h), zero)


def pose_similarity(predicted: Column, truth: Column, area: Column) -> Column:
    """Object keypoint similarity over the points visible in the truth."""
    total, seen = F.lit(0.0), F.lit(0)
    for i, sigma in enumerate(OKS_SIGMAS):
        dx = _num(predicted, 3 * i) - _num(truth, 3 * i)
        dy = _num(predicted, 3 * i + 1) - _num(truth, 3 * i + 1)
        visible = _num(truth, 3 * i + 2) > 0
        spread = F.lit(2.0) * area * F.lit((2 * sigma) ** 2)
        near = F.exp(-F.try_divide(dx * dx + dy * dy, spread))       # NULL without an area
        total = total + F.when(visible, near).otherwise(0.0)
        seen = seen + F.when(visible, 1).otherwise(0)
    return F.try_divide(total, seen)


def normalised_box(box: Column, width: Column, height: Column) -> list[Column]:
    """Centre x, centre y, width and height as shares of the image."""
    x, y, w, h = (_num(box, i) for i in range(4))
    return [(x + w / 2) / width, (y + h / 2) / height, w / width, h / height]


def label_line(category: Column, box: Column, width: Column, height: Column,
               pose: Column | None = None, digits: int = 6) -> Column:
    """One training label line: class, centre box and, with a pose, its points."""
    def text(c):
        return F.format_string(f"%.{digits}f", c)

    parts = [category.cast("string")] + [text(c) for c in normalised_box(box, width, height)]
    if pose is not None:
        for i in range(len(KEYPOINTS)):
            parts += [text(_num(pose, 3 * i) / width), text(_num(pose, 3 * i + 1) / height),
                      _num(pose, 3 * i + 2).cast("int").cast("string")]
    return F.concat_ws(" ", *parts)


def dataset_description(sport: str, root: str, train: str = "train", val: str = "val",
                        keypoints: bool = True) -> dict:
    """What a trainer must know about the exported label files."""
    spec = SPORTS[sport]
    out = {"path": f"{root}/splits/{sport}",
           "train": f"{root}/images/{sport}/{train}", "val": f"{root}/images/{sport}/{val}",
           "names": dict(enumerate(spec.classes))}
    if keypoints:
        out["kpt_shape"] = [len(KEYPOINTS), 3]
        out["flip_idx"] = FLIP_INDEX
        out["skeleton"] = [[keypoint_index(a), keypoint_index(b)] for a, b in LIMBS]
    return out


def joint_distance(p: list[Column], q: list[Column]) -> Column:
    squares = [(a - b) * (a - b) for a, b in zip(p, q)]
    return F.sqrt(reduce(lambda s, t: s + t, squares))
