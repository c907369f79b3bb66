"""Token counts of fields or sections from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.base import chunks, in_arrow
from fieldmark.llm.tokenizing import byte_encoder, vocabulary

RULES = ("most", "first", "last")


def token_spans(text: str, encoding, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of every token, in code points.

    Byte lengths of the ids add up to byte offsets; a running count of the bytes that
    begin a character turns those into characters. Tokens that hold parts of one
    character all cover it.
    """
    data = text.encode("utf-8")
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(sizes[ids])
    if len(ids) and ends[-1] != len(data):
        raise ValueError("tokens do not cover the text")
    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return character[ends - sizes[ids]], character[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those cross a boundary.

    Sections lie side by side: section i is [bounds[i], bounds[i + 1]). A token inside one
    section is its. A crossing token goes to the section of its first or last character,
    or to the one with most of its characters, the earlier if equal.
    """
    n = len(bounds) - 1
    low = np.searchsorted(bounds, starts, "right") - 1
    high = np.searchsorted(bounds, ends - 1, "right") - 1
    owner = high.copy() if rule == "last" else low.copy()
    crossing = np.flatnonzero(low != high)
    if rule == "most":
        for t in crossing:
            sections = np.arange(low[t], high[t] + 1)
            share = np.minimum(bounds[sections + 1], ends[t]) - np.maximum(bounds[sections], starts[t])
            owner[t] = sections[np.argmax(share)]
    return np.bincount(owner, minlength=n)[:n], np.bincount(owner[crossing], minlength=n)[:n]


def line_bounds(text: str) -> np.ndarray:
    """Bounds of the lines; a line feed belongs to the line it ends. One empty section for an empty text."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return np.unique(np.concatenate([[0], at, [len(text)]])) if text else np.zeros(2, np.int64)


def count_tokens(docs: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), cuts: str | None = None,
                 rule: str = "most", vocabulary_path: str | None = None) -> DataFrame:
    """Tokens of every section of every document: the kept columns, section, start, end, n_tokens, n_crossing.

    Each document is encoded once, whole, so tokens are those a model would see. Sections
    are the lines, or, with `cuts`, what lies between the offsets (code points) in that
    array column. Each token counts for exactly one section (see `attribute`), so a
    document's sections add up to its tokens.

    NULL and empty texts have one empty section without tokens; cuts outside the text
    and repeated ones are ignored, NULL cuts are none; repeated rows are documents of
    their own; no documents give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary_path or vocabulary("byte_bpe_50k.tiktoken")
    keep = list(keep)
    names = keep + ["section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = byte_encoder(path)
        for batch in chunks(batches, "__text"):
            rows, parts = [], []
            own_cuts = batch.column("__cuts").to_pylist() if cuts else None
            for i, t in enumerate(batch.column("__text").to_pylist()):
                t = t or ""
                if cuts:
                    inner = {c for c in own_cuts[i] or () if c is not None and 0 < c < len(t)}
                    bounds = np.array([0, *sorted(inner), len(t)], np.int64)
                else:
                    bounds = line_bounds(t)
                starts, ends = token_spans(t, encoding, sizes)
                total, crossing = attribute(starts, ends, bounds, rule)
                rows.append(np.full(len(total), i))
                parts.append(np.stack([np.arange(len(total)), bounds[:-1], bounds[1:], total, crossing]))
            at, columns = pa.array(np.concatenate(rows)), np.concatenate(parts, axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in keep] + [pa.array(c) for c in columns], names)

    own = docs.select(*keep, F.col(text).cast("string").alias("__text"), *([F.col(cuts).cast("array<long>").alias("__cuts")] if cuts else []))
    kinds = dict(own.dtypes)
    return own.transform(in_arrow, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in names[len(keep):])]))
