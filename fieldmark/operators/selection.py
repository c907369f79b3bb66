"""Exact order statistics of whole columns without sorting or shuffling them.

Each pass is one aggregation. A bracket around the wanted rank is narrowed with
the mergeable quantile sketch and checked with exact counts until few enough
values remain to be sorted. Only scalars come back to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT_BELOW = 100_000    # values that one task may sort
_ACCURACY = 20_000
_MARGIN = 4.0 / _ACCURACY
_VALUES_PER_JOB = 1_000_000
_SKETCHES_PER_JOB = 64


@dataclass
class _Search:
    expr: Column
    rank: int            # 1-based
    low: object
    high: object
    below: int           # values < low
    inside: int          # values in [low, high]
    answer: object = None
    trial: tuple | None = None
    stalled: bool = False

    @property
    def range(self) -> Column:
        return (self.expr >= F.lit(self.low)) & (self.expr <= F.lit(self.high))

    @property
    def open(self) -> bool:
        return self.answer is None


def values_at_ranks(df: DataFrame, columns: dict[str, Column],
                    ranks: Callable[[str, int], list[int]],
                    exact_below: int = EXACT_BELOW) -> dict[str, list]:
    """For each named numeric column the values at 1-based ranks of its non-null values.

    `ranks(name, n)` says which, given the number of values.
    """
    names = list(columns)
    first = df.agg(*[f(columns[c]).alias(f"{k}{i}") for i, c in enumerate(names)
                     for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    searches: dict[str, list[_Search]] = {}
    for i, c in enumerate(names):
        n = first[f"n{i}"]
        searches[c] = [_Search(columns[c], r, first[f"lo{i}"], first[f"hi{i}"], 0, n)
                       for r in (ranks(c, n) if n else [])]
    everyone = [s for group in searches.values() for s in group]
    while True:
        for s in everyone:
            if s.open and s.low == s.high:
                s.answer = s.low
        if not any(s.open for s in everyone):
            break
        small = [s for s in everyone if s.open and s.inside <= exact_below]
        if small:
            _sort_inside(df, small)
        wide = [s for s in everyone if s.open]
        for start in range(0, len(wide), _SKETCHES_PER_JOB):
            _narrow(df, wide[start:start + _SKETCHES_PER_JOB])
    return {c: [s.answer for s in group] for c, group in searches.items()}


def _sort_inside(df: DataFrame, searches: list[_Search]) -> None:
    """Sort what is left. Ranks in the same bracket share one list; a job holds a bounded number."""
    brackets: dict[tuple, list[_Search]] = {}
    for s in searches:
        brackets.setdefault((id(s.expr), s.low, s.high), []).append(s)
    jobs, held = [[]], 0
    for group in brackets.values():
        if jobs[-1] and held + group[0].inside > _VALUES_PER_JOB:
            jobs, held = [*jobs, []], 0
        jobs[-1].append(group)
        held += group[0].inside
    for job in jobs:
        lists = df.agg(*[F.sort_array(F.collect_list(F.when(g[0].range, g[0].expr))).alias(f"l{i}")
                         for i, g in enumerate(job)])
        row = lists.select(*[F.get(f"l{i}", F.lit(s.rank - s.below - 1)).alias(f"v{i}_{j}")
                             for i, g in enumerate(job) for j, s in enumerate(g)]).first()
        for i, g in enumerate(job):
            for j, s in enumerate(g):
                s.answer = row[f"v{i}_{j}"]


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    guided = [s for s in searches if not s.stalled]
    if guided:
        points = []
        for s in guided:
            share = (s.rank - s.below) / s.inside
            points.append([max(0.0, share - _MARGIN), min(1.0, share + _MARGIN)])
        row = df.agg(*[F.percentile_approx(F.when(s.range, s.expr), p, _ACCURACY).alias(f"q{i}")
                       for i, (s, p) in enumerate(zip(guided, points))]).first()
        for i, s in enumerate(guided):
            low, high = row[f"q{i}"]
            s.trial = (max(s.low, low - _slack(low)), min(s.high, high + _slack(high)))
    for s in searches:
        if s.stalled:       # halve the range of values: this always comes to an end
            s.trial = (s.low, _middle(s.low, s.high))
    counts = df.agg(*[c for i, s in enumerate(searches) for c in (
        F.count(F.when(s.range & (s.expr < F.lit(s.trial[0])), 1)).alias(f"b{i}"),
        F.count(F.when(s.range & (s.expr >= F.lit(s.trial[0])) & (s.expr <= F.lit(s.trial[1])), 1))
        .alias(f"i{i}"))]).first()
    for i, s in enumerate(searches):
        below, inside, wanted = counts[f"b{i}"], counts[f"i{i}"], s.rank - s.below
        before = s.inside
        if wanted <= below:
            s.high, s.inside = _next(s.trial[0], -1), below
        elif wanted <= below + inside:
            (s.low, s.high), s.below, s.inside = s.trial, s.below + below, inside
        else:
            s.low, s.below = _next(s.trial[1], 1), s.below + below + inside
            s.inside = before - below - inside
        s.stalled = s.inside > before // 2


def _slack(value):
    """The sketch holds doubles: what a whole number beyond 2**53 may be off by."""
    return 0 if isinstance(value, float) else max(0, 2 ** max(0, abs(value).bit_length() - 53) - 1)


def _middle(low, high):
    if isinstance(low, float):
        return max(low, min(low / 2 + high / 2, math.nextafter(high, -math.inf)))
    return low + (high - low) // 2


def _next(value, step: int):
    return math.nextafter(value, step * math.inf) if isinstance(value, float) else value + step


def medians(df: DataFrame, columns: dict[str, Column],
            exact_below: int = EXACT_BELOW) -> dict[str, float | None]:
    """Exact medians (mean of the two middle values), None for empty columns."""
    found = values_at_ranks(df, columns, lambda _, n: [(n + 1) // 2, n // 2 + 1], exact_below)
    return {c: (float(v[0]) + float(v[1])) / 2 if v else None for c, v in found.items()}
