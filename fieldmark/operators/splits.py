"""Stratified row caps, hold-outs and folds without moving rows.

Rows are ordered within their class by a seeded hash of their key (or by the
key itself). Which rows belong to a part is then a comparison with exact cut
values, found by operators.selection; the data is neither sorted nor shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.selection import EXACT_BELOW, values_at_ranks

_MAX_CLASSES = 200


def position(key: str | list[str], seed: int | None) -> Column:
    """What rows are ordered by: a hash of (seed, key columns), or the numeric key if seed is None."""
    names = [key] if isinstance(key, str) else key
    return F.col(names[0]) if seed is None else F.xxhash64(F.lit(seed), *[F.col(n) for n in names])


def class_sizes(df: DataFrame, label: str | None) -> dict:
    if label is None:
        return {None: df.count()}
    rows = df.groupBy(label).count().orderBy(label).limit(_MAX_CLASSES + 1).collect()
    if len(rows) > _MAX_CLASSES:
        raise ValueError(f"{label} has more than {_MAX_CLASSES} classes")
    return {r[label]: r["count"] for r in rows}


def share_out(sizes: dict, total: int) -> dict:
    """`total` split in proportion to the class sizes: floor, then largest remainder."""
    n = sum(sizes.values())
    exact = {c: total * s / n for c, s in sizes.items()}
    out = {c: math.floor(x) for c, x in exact.items()}
    left = total - sum(out.values())
    for c in sorted(sizes, key=lambda c: (out[c] - exact[c], str(c)))[:left]:
        out[c] += 1
    return out


def _in_class(label: str | None, value) -> Column:
    return F.lit(True) if label is None else F.col(label).eqNullSafe(F.lit(value))


def _cuts(df: DataFrame, label: str | None, pos: Column, ranks: dict, exact_below: int) -> dict:
    """Per class the positions at the given ranks."""
    names = {f"c{i}": c for i, c in enumerate(ranks)}
    found = values_at_ranks(df, {n: F.when(_in_class(label, c), pos) for n, c in names.items()},
                            lambda n, _: ranks[names[n]], exact_below)
    return {names[n]: v for n, v in found.items()}


def _first_of_class(df: DataFrame, label, key, seed, quota: dict, exact_below: int) -> Column:
    """TRUE for the first quota[c] rows of each class c."""
    pos = position(key, seed)
    cuts = _cuts(df, label, pos, {c: [q] for c, q in quota.items() if q > 0}, exact_below)
    out = F.lit(False)
    for c, (cut,) in cuts.items():
        out = out | (_in_class(label, c) & (pos <= F.lit(cut)))
    return out


def row_cap(df: DataFrame, label: str, key: str | list[str], rows: int, seed: int | None = 42,
            exact_below: int = EXACT_BELOW) -> DataFrame:
    """At most `rows` rows, classes in proportion; 0 switches the cap off."""
    sizes = class_sizes(df, label)
    if not rows or sum(sizes.values()) <= rows:
        return df
    return df.where(_first_of_class(df, label, key, seed, share_out(sizes, rows), exact_below))


def hold_out(df: DataFrame, label: str | None, key: str | list[str], share: float = 0.2,
             seed: int | None = 42, exact_below: int = EXACT_BELOW) -> DataFrame:
    """Add `is_test`: ceil(share * rows) rows, classes in proportion unless label is None."""
    sizes = class_sizes(df, label)
    quota = share_out(sizes, math.ceil(share * sum(sizes.values())))
    return df.withColumn("is_test", _first_of_class(df, label, key, seed, quota, exact_below))


def fold_sizes(sizes: dict, folds: int) -> dict:
    """Per class the rows of each fold: classes laid end to end, dealt out in turn."""
    out, start = {}, 0
    for c, n in sizes.items():
        out[c] = [len(range((f - start) % folds, n, folds)) for f in range(folds)]
        start += n
    return out


def folds(df: DataFrame, label: str, key: str | list[str], k: int = 5, seed: int | None = 42,
          exact_below: int = EXACT_BELOW) -> DataFrame:
    """Add `fold` (0..k-1): fold sizes differ by at most one row, also within a class."""
    pos = position(key, seed)
    sizes = fold_sizes(class_sizes(df, label), k)
    ranks = {c: [sum(s[:i + 1]) for i in range(k - 1)] for c, s in sizes.items()}
    ranks = {c: [max(1, r) for r in rs] for c, rs in ranks.items()}
    cuts = _cuts(df, label, pos, ranks, exact_below)
    out = None
    for c, values in cuts.items():
        inner = None
        for f, cut in enumerate(values):
            if sizes[c][f] == 0:
                continue
            hit = pos <= F.lit(cut)
            inner = F.when(hit, f) if inner is None else inner.when(hit, f)
        inner = F.lit(k - 1) if inner is None else inner.otherwise(k - 1)
        out = F.when(_in_class(label, c), inner) if out is None else out.when(_in_class(label, c), inner)
    return df.withColumn("fold", out.cast("int"))
