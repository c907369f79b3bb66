"""Document quality by pairwise ranking (Bradley-Terry) on features of the whole text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.base import broadcast_if, chunks, in_arrow, named, settle, worker_state

# Labelled documents of each class that the fit uses at most: those with the least hash of their id.
FIT_ROWS = 4_000
# Preference pairs of the fit: each document of the smaller class meets this many of the other.
PAIRS_PER_ROW = 8
RIDGE = 1e-3
ACCEPT = 0.7

# Character classes; every text is a sequence of them.
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _COMMA, _MARK, _SYMBOL, _BAR, _ACCENT, _OTHER = range(12)
CLASSES = 12
RUNS = 10
FEATURES = CLASSES + CLASSES * CLASSES + RUNS


def _class_table() -> np.ndarray:
    """Class of each code point below 65536; higher ones count as other letters."""
    table = np.full(65536, _OTHER, np.uint8)
    for c in range(65536):
        kind = unicodedata.category(chr(c))
        if kind in ("Ll", "Lo", "Lm"):
            table[c] = _LOWER if c < 128 else _ACCENT
        elif kind in ("Lu", "Lt"):
            table[c] = _UPPER
        elif kind[0] == "N":
            table[c] = _DIGIT
        elif kind[0] in "PS":
            table[c] = _SYMBOL
    for chars, kind in (("\n\r", _LINE), (" \t\x0b\x0c", _SPACE), (".", _STOP), (",;:", _COMMA),
                        ("!?'\"()-", _MARK), ("|", _BAR)):
        for ch in chars:
            table[ord(ch)] = kind
    return table


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: class and class-pair frequencies, repetition, lengths. Zero for an empty one."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = worker_state("quality_classes", _class_table)[np.minimum(points, 65535)].astype(np.int64)
    n = len(kinds)
    single = np.bincount(kinds, minlength=CLASSES) / n
    double = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) / n
    out[:CLASSES + CLASSES * CLASSES] = np.log1p(200.0 * np.concatenate([single, double]))
    words = text.split()
    if words:
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        lines = [x for x in text.split("\n") if x.strip()]
        same = sum(map(str.__eq__, words, words[1:]))
        out[-RUNS:] = (np.log1p(len(words)), len(counts) / len(words), max(counts.values()) / len(words),
                       same / len(words), len(set(lines)) / len(lines), np.log1p(n / len(words)),
                       np.log1p(len(words) / len(lines)), len(counts) / len(words) * np.log1p(len(words)),
                       np.log1p(max(map(len, words))), sum(map(str.istitle, words)) / len(words))
    return out


@dataclass
class Ranker:
    """score(x) = weights . (x - mean) / scale; cut: the score quantile from which documents are accepted."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, increasing in the raw score, ACCEPT at the cut."""
        z = (self.raw(x) - self.cut) / self.spread + np.log(ACCEPT / (1 - ACCEPT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_ranker(good: np.ndarray, bad: np.ndarray, seed: int = 7) -> Ranker:
    """Learn weights so that good documents outrank bad ones, then a cut between them.

    Loss: log(1 + exp(-w . (x_good - x_bad))) over the pairs, plus a ridge, by Newton
    steps. The cut is the score quantile of the fitted rows with the best balanced
    accuracy; without one of the classes every document is accepted (or none).
    """
    width = FEATURES
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0 if len(good) or not len(bad) else 1.0, 1.0)
    good, bad = good.astype(np.float64), bad.astype(np.float64)
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-6] = 1.0
    rng = np.random.default_rng(seed)
    few, many = sorted((len(good), len(bad)))
    at = np.tile(np.arange(few), PAIRS_PER_ROW)
    other = np.concatenate([rng.permutation(many) for _ in range(-(-len(at) // many))])[:len(at)]
    i, j = (at, other) if len(good) == few else (other, at)
    x = (good[i] - bad[j]) / scale
    w = np.zeros(width)
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(np.clip(x @ w, -50, 50)))
        grad = -(x.T @ p) / len(x) + RIDGE * w
        curve = (x.T * (p * (1 - p))) @ x / len(x) + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = ((both - mean) / scale) @ w
    label = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    order = np.argsort(raw, kind="stable")
    s, y = raw[order], label[order]
    # cutting below position k rejects the first k rows
    gain = np.concatenate([[0.0], np.cumsum((1 - y) / len(bad) - y / len(good))])
    k = int(np.median(np.flatnonzero(gain >= gain.max() - 1e-12)))
    cut = s[0] - 1.0 if k == 0 else s[-1] + 1.0 if k == len(s) else (s[k - 1] + s[k]) / 2
    return Ranker(mean, scale, w, float(cut), float(max(raw.std() / 4, 1e-9)))


def _vectors(docs: DataFrame, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = np.array([features(t) for t in batch.column("text").to_pylist()], np.float32)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [vectors], columns + ["features"])
    kinds = dict(docs.dtypes)
    return docs.select(*columns, "text").transform(in_arrow, run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", features array<float>")


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                label: str = "quality", rows: int = FIT_ROWS) -> Ranker:
    """Fit on at most `rows` labelled documents of each class, none of them held out.

    A doc_id with several labels counts by their mean (1 from one half up); NULL labels
    and labels without a document are ignored. Repeated documents count once each.
    """
    known = (labels.select(F.col(doc_id).cast("long").alias("key"), F.col(label).cast("double").alias("label"))
             .where("key is not null and label is not null").groupBy("key").agg(F.avg("label").alias("label"))
             .where(~held_out(F.col("key"))).withColumn("label", (F.col("label") >= 0.5).cast("int")))
    known = settle(known, "labels")
    # Only labels with a document can be learnt from.
    known = settle(known.join(docs.select(F.col(doc_id).cast("long").alias("key")), "key", "left_semi"), "labels")
    chosen = known.where("label = 1").orderBy(F.xxhash64("key"), "key").limit(rows).unionByName(
        known.where("label = 0").orderBy(F.xxhash64("key"), "key").limit(rows))
    chosen = settle(chosen, "chosen")
    own = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    found = _vectors(own.join(F.broadcast(chosen), "key"), ["key", "label"]).dropDuplicates(["key"]).collect()
    found.sort(key=lambda r: r["key"])
    group = lambda y: np.array([r["features"] for r in found if r["label"] == y], np.float32).reshape(-1, FEATURES)
    return fit_ranker(group(1), group(0))


def score_quality(docs: DataFrame, ranker: Ranker, text: str = "text", keep: list[str] = ("doc_id",),
                  output: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The kept columns, score and predicted (1 from ACCEPT up) of every document; `output` names the last two.

    Reads nothing but the text. NULL and empty texts have the score of the zero vector;
    equal texts have equal scores; no documents give no rows.
    """
    # Inside the task columns go by number, so their names may be any.
    names, keep = list(keep), [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, read):
            rows = np.array([features(t) for t in batch.column(read).to_pylist()], np.float32)
            score = ranker.score(rows.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))],
                [*keep, "score", "predicted"])

    # A text that is kept anyway is not sent twice.
    read = keep[names.index(text)] if text in names and dict(docs.dtypes)[text] == "string" else "text"
    own = docs.select(*[named(n).alias(c) for n, c in zip(names, keep)], *([named(text).cast("string").alias("text")] if read == "text" else []))
    kinds = dict(own.dtypes)
    scored = own.transform(in_arrow, run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "score double, predicted int"]))
    return scored.toDF(*names, *output)
