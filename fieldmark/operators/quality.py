"""Named row rules: keep a row only where every rule is TRUE."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Rule name -> SQL predicate. A predicate that is NULL counts as failed."""

    rules: dict[str, str] = field(default_factory=dict)

    def _ok(self, predicate: str) -> Column:
        return F.coalesce(F.expr(predicate), F.lit(False))

    def _all(self) -> Column:
        out = F.lit(True)
        for p in self.rules.values():
            out = out & self._ok(p)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        # Plain predicates, so that they reach the scan; a filter drops NULL too.
        for p in self.rules.values():
            df = df.where(p)
        return df

    def quarantine(self, df: DataFrame) -> DataFrame:
        """The dropped rows with the names of the rules they failed."""
        failed = F.filter(F.array(*[F.when(~self._ok(p), F.lit(n)) for n, p in self.rules.items()]),
                          lambda x: x.isNotNull())
        return df.where(~self._all()).withColumn("failed_rules", failed)

    def _counts(self) -> list[Column]:
        return ([F.count(F.lit(1)).alias("rows_in"),
                 F.count(F.when(self._all(), 1)).alias("rows_kept")]
                + [F.count(F.when(~self._ok(p), 1)).alias(n) for n, p in self.rules.items()])

    def drop_counts(self, df: DataFrame) -> DataFrame:
        """(rule, dropped) for each rule, from one aggregation."""
        counts = df.agg(*self._counts())
        return counts.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("rule"), F.col(n).alias("dropped")) for n in self.rules
        ])).alias("r")).select("r.*")

    def observe(self, df: DataFrame, observation: Observation | str) -> DataFrame:
        """Count per rule while the rows pass by, also in a stream."""
        return df.observe(observation, *self._counts())


# --- fixed values: the rules of the refinement layers -------------------------
IMAGE_RULES = Rules({"known_split": "split IN ('train', 'val', 'test')"})
KEYPOINT_RULES = Rules({"has_bbox_area": "bbox_area > 0",
                        "enough_visible_keypoints": "num_visible_keypoints >= 5"})
GAME_RULES = Rules({"non_negative_score": "points_for >= 0 AND points_against >= 0"})
