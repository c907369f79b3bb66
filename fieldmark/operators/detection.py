"""Average precision of boxes and poses (COCO definition) as joins, windows and sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.geometry import box_iou, pose_similarity
from fieldmark.operators.hotkeys import broadcast_small, join_unique
from fieldmark.operators.ordered import SEGMENT, Segments, find_segments, null_safe_join, segment_totals
from fieldmark.session import settle

# --- fixed values of the published evaluation ---------------------------------
THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
RECALL_STEPS = 100          # recall points 0, 1/100, ..., 1
BOX_DETECTIONS = 100        # best scored detections looked at per image and class
POSE_DETECTIONS = 20

_GROUP = ["image_id", "category_id"]
_ORDER = ["__down", "image_id", "det_id"]
Similarity = Callable[[Column, Column, Column], Column]


def box_similarity(predicted: Column, truth: Column, area: Column) -> Column:
    return box_iou(predicted, truth)


def match(detections: DataFrame, truths: DataFrame, similarity: Similarity = box_similarity,
          thresholds: list[float] = THRESHOLDS, best: int = BOX_DETECTIONS) -> DataFrame:
    """Which detections hit a truth, per similarity threshold.

    detections: image_id, category_id, det_id, score, shape
    truths:     image_id, category_id, truth_id, shape, area
    result:     category_id, image_id, det_id, score, hit (array of 0/1, one per threshold)

    In the order of their scores, detections take the most similar truth of
    their image and class that is still free (equals: the lower truth id).
    """
    by_score = Window.partitionBy(*_GROUP).orderBy(F.desc("score"), F.asc("det_id"))
    ranked = detections.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= best)
    shapes = ranked.select(*_GROUP, "rank", F.col("shape").alias("det_shape"))
    value = similarity(F.col("det_shape"), F.col("shape"), F.col("area"))
    # A class of an image has at most `best` ranked detections, so the pairs grow
    # with the truths; only pairs above the lowest threshold leave the join.
    pairs = (join_unique(truths.select(*_GROUP, "truth_id", "shape", "area"), shapes, _GROUP, "inner")
             .withColumn("similarity", value)
             .where(F.col("similarity") >= min(thresholds))
             .select(*_GROUP, "rank", "truth_id", "similarity"))
    # Earlier detections can take at most best - 1 truths, so the `best` most
    # similar truths of a detection always contain the one it gets.
    by_similarity = (Window.partitionBy(*_GROUP, "rank")
                     .orderBy(F.desc("similarity"), F.asc("truth_id")))
    near = pairs.withColumn("__n", F.row_number().over(by_similarity)).where(F.col("__n") <= best)
    queue = F.sort_array(F.collect_list(F.struct("rank", "__n", "truth_id", "similarity")))
    taken = (near.groupBy(*_GROUP).agg(queue.alias("queue"))       # at most best * best pairs
             .select(*_GROUP, F.array(*[_greedy(F.col("queue"), t) for t in thresholds])
                     .alias("taken")))
    # Neither side has more than `best` rows per key: no hot keys here.
    flagged = ranked.drop("shape").join(taken, _GROUP, "left")
    hit = F.array(*[
        F.coalesce(F.array_contains(F.get("taken", F.lit(i)), F.col("rank")), F.lit(False)).cast("int")
        for i in range(len(thresholds))])
    return flagged.select("category_id", "image_id", "det_id", "score", hit.alias("hit"))


def _greedy(queue: Column, threshold: float) -> Column:
    """Ranks of the detections that get a truth at this threshold."""
    start = F.struct(F.array().cast("array<int>").alias("ranks"),
                     F.slice(F.transform(queue, lambda p: p["truth_id"]), 1, 0).alias("truths"))

    def step(state: Column, pair: Column) -> Column:
        free = ((pair["similarity"] >= threshold)
                & ~F.array_contains(state["ranks"], pair["rank"])
                & ~F.array_contains(state["truths"], pair["truth_id"]))
        return F.when(free, F.struct(
            F.array_append(state["ranks"], pair["rank"]).alias("ranks"),
            F.array_append(state["truths"], pair["truth_id"]).alias("truths"))).otherwise(state)

    return F.reduce(queue, start, step, lambda state: state["ranks"])


def _narrow(matches: DataFrame, limit: int | None) -> tuple[DataFrame, Segments | None]:
    """Detections in as few bytes as they need: the order, and all hits as the bits of one number."""
    rows = matches.select(
        "category_id", (-F.col("score")).alias("__down"), "image_id", "det_id",
        F.aggregate("hit", F.lit(0).cast("long"), lambda bits, one: bits * 2 + one).alias("__bits"))
    return rows, find_segments(rows, ["category_id"], _ORDER, limit)


def precision_steps(matches: DataFrame, truths: DataFrame, thresholds: list[float] = THRESHOLDS,
                    limit: int | None = None) -> DataFrame:
    """The best precision at each recall, recall in whole hundredths: at most 101 rows per class and threshold.

    result: category_id, at (number of the threshold), step, precision

    Detections move once, in the order of their scores; all thresholds are counted side by
    side there, and only the best of each step leaves the task.
    """
    keys, at = ["category_id"], range(len(thresholds))
    rows, seg = _narrow(matches, limit)
    per_class = truths.groupBy("category_id").agg(F.count(F.lit(1)).alias("truths"))
    if seg is None:
        rows, parts = rows.withColumn(SEGMENT, F.lit(0)), keys
    else:
        rows, parts = seg.tag(rows), [*keys, SEGMENT]
    bit = [F.shiftright("__bits", len(thresholds) - 1 - i).bitwiseAND(F.lit(1)) for i in at]
    # Sorted while rows are narrow; the columns of the thresholds are made behind the sort.
    ordered = (rows.repartition(*parts).sortWithinPartitions(*parts, *_ORDER)
               .withColumns({"__one": F.lit(1).cast("long")} | {f"__hit{i}": b for i, b in zip(at, bit)}))
    sums = {"__seen": "__one"} | {f"__n{i}": f"__hit{i}" for i in at}
    w = Window.partitionBy(*parts).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    run = ordered.withColumns({out: F.sum(c).over(w) for out, c in sums.items()})
    if seg is not None:
        carried = segment_totals(rows.withColumns({"__one": F.lit(1).cast("long")} | {f"__hit{i}": b for i, b in zip(at, bit)}), seg, sums)
        run = (null_safe_join(run, carried, parts)
               .withColumns({out: F.col(out) + F.coalesce(f"__b_{out}", F.lit(0)) for out in sums}))
    counted = run.join(broadcast_small(per_class), "category_id")
    hits = F.filter(F.array(*[
        F.when(F.col(f"__hit{i}") == 1, F.struct(
            F.lit(i).alias("at"), F.expr(f"({RECALL_STEPS} * __n{i}) div truths").alias("step"),
            (F.col(f"__n{i}") / F.col("__seen")).alias("precision"))) for i in at]), F.isnotnull)
    return (counted.select(*keys, F.explode(hits).alias("p")).select(*keys, "p.*")
            .groupBy(*keys, "at", "step").agg(F.max("precision").alias("precision")))


def average_precision(matches: DataFrame, truths: DataFrame,
                      thresholds: list[float] = THRESHOLDS, limit: int | None = None) -> DataFrame:
    """(category_id, threshold, ap) for the classes that have truths."""
    # A recall point takes the best precision from the first hit that reaches it on: the best
    # of its step and those behind. A step stands for all points above the step before.
    behind = Window.partitionBy("category_id", "at").orderBy(F.desc("step"))
    before = Window.partitionBy("category_id", "at").orderBy("step")
    steps = (precision_steps(matches, truths, thresholds, limit)
             .withColumn("envelope", F.max("precision").over(behind.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("points", F.col("step") - F.lag("step", 1, -1).over(before)))
    found = (steps.groupBy("category_id", F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("at") + 1).alias("threshold"))
             .agg((F.sum(F.col("envelope") * F.col("points")) / (RECALL_STEPS + 1)).alias("ap")))
    # Classes without any hit are no rows of `found` and count with 0.
    wanted = truths.select("category_id").distinct().select(
        "category_id", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return (wanted.join(found, ["category_id", "threshold"], "left").na.fill(0.0, ["ap"]))


def mean_average_precision(matches: DataFrame, truths: DataFrame, thresholds: list[float] = THRESHOLDS,
                           names: tuple[str, str] = ("detect_map", "detect_map50"),
                           limit: int | None = None) -> DataFrame:
    """One row: mean over classes and thresholds, and mean over classes at 0.5."""
    found = average_precision(matches, truths, thresholds, limit)
    return found.agg(F.avg("ap").alias(names[0]),
                     F.avg(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias(names[1]))


def left_out(detections: DataFrame, best: int = BOX_DETECTIONS) -> DataFrame:
    """One row: how many detections lie beyond the `best` of their image and class."""
    beyond = detections.groupBy(*_GROUP).count().select(F.greatest(F.col("count") - best, F.lit(0)).alias("n"))
    return beyond.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("left_out"))


def box_map(detections: DataFrame, truths: DataFrame, best: int = BOX_DETECTIONS, **options) -> DataFrame:
    """Mean average precision of boxes over the `best` scored detections of each image and class.

    The published metric looks at 100; `left_out` counts the others.
    """
    found = settle(match(detections, truths, best=best), "box-matches")
    return mean_average_precision(found, truths, **options)


def pose_map(detections: DataFrame, truths: DataFrame, best: int = POSE_DETECTIONS, **options) -> DataFrame:
    """As box_map, for poses; the published metric looks at 20."""
    found = settle(match(detections, truths, pose_similarity, best=best), "pose-matches")
    return mean_average_precision(found, truths, names=("pose_map", "pose_oks"), **options)
