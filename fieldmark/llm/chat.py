"""Chat formatting: turns laid out as bytes, column by column."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.base import chunks, in_arrow

# The template: START role \n text END \n
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"

# A control string begins with "<|". In texts and roles every "<|", also one with
# backslashes inside, gets one backslash more, so no control string is left in them.
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(s: str) -> str:
    return _OPEN.sub(r"<\\\1|", s) if "<" in s else s


def unescape(s: str) -> str:
    return _SHUT.sub(r"<\1|", s) if "<" in s else s


def escape_role(s: str) -> str:
    """Roles end at the line's end, so line feeds in them are written as a control string."""
    return escape(s).replace("\n", "<|n|>")


def unescape_role(s: str) -> str:
    return unescape(s.replace("<|n|>", "\n"))


def assemble(roles: list[str], texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Formatted turns in one Arrow buffer, and where the text of each begins and ends (code points).

    Segment lengths are known first; their running sum gives every segment's place in one
    buffer that is allocated once. The fixed segments are copied by index in numpy; roles
    and texts come as the bytes that Arrow already holds side by side.
    """
    n = len(roles)
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END + "\n")]
    parts = [pa.array([escape_role(x) for x in roles], pa.large_string()), pa.array([escape(x) for x in texts], pa.large_string())]
    spans, data = [], []
    for p in parts:
        spans.append(np.frombuffer(p.buffers()[1], np.int64)[p.offset:p.offset + n + 1])
        data.append(np.frombuffer(p.buffers()[2] or b"", np.uint8))
    role_len, text_len = np.diff(spans[0]), np.diff(spans[1])
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = len(fixed[0]), role_len, len(fixed[1])
    lengths[:, 3], lengths[:, 4] = text_len, len(fixed[2])
    ends = np.cumsum(lengths.ravel())
    starts = np.concatenate([[0], ends])[:-1].reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for column, value in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[starts[:, column, None] + np.arange(len(value))] = value
    for column, (span, size, source) in ((1, (spans[0], role_len, data[0])), (3, (spans[1], text_len, data[1]))):
        shift = np.repeat(starts[:, column] - span[:-1], size)
        out[np.arange(span[0], span[-1]) + shift] = source[span[0]:span[-1]]
    offsets = np.concatenate([[0], ends[4::5]]).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())
    chars = [pa.compute.utf8_length(p).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts]
    begin = len(START) + chars[0] + 1
    return pieces, begin, begin + chars[1]


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", trained_role: str = TRAINED_ROLE) -> DataFrame:
    """Each turn's piece of its conversation: conv_id, turn, piece, loss_start, loss_end.

    A conversation's string is its pieces by turn, one behind the other; ties of a turn
    are ordered by the piece. loss_start and loss_end are code points within the piece,
    equal for turns that are not trained on. No shuffle: a conversation of any length is
    never gathered here. NULL roles and texts are empty; repeated rows are turns of their
    own; no rows give no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            roles = [x or "" for x in batch.column("role").to_pylist()]
            pieces, start, end = assemble(roles, [x or "" for x in batch.column("text").to_pylist()])
            end = np.where([r == trained_role for r in roles], end, start)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pieces, pa.array(start), pa.array(end)],
                                             ["conv_id", "turn", "piece", "loss_start", "loss_end"])
    own = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                       F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return own.transform(in_arrow, run, "conv_id long, turn long, piece string, loss_start long, loss_end long")


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn: the inverse of the template."""
    if not (piece.startswith(START) and piece.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, _, text = piece[len(START):-len(END) - 1].partition("\n")
    return unescape_role(role), unescape(text)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold.

    Pieces of a conversation meet in one task in order and are read as a stream; only
    the running digests are kept, so a conversation of any length fits.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def row(state):
        conv, n, turns, chars, loss, total = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
                if state is None or state[0] != conv:
                    if state:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_piece(piece)
                masked = unescape(piece[start:end])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(masked)
                state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
            if done:
                yield batch_of(done)
        if state:
            yield batch_of([row(state)])

    dealt = pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_first(), "piece")
    return dealt.transform(in_arrow, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
