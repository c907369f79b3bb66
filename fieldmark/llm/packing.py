"""Packing token sequences into windows by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.base import chunks, in_arrow
from fieldmark.llm.tokenizing import vocabulary, word_encoder

CAPACITY = 2048
END_ID = 1

# Ids a task holds back before it packs: the more, the more choice for each window.
LOOKAHEAD_IDS = 4_000_000

# Sequence numbers: the task's number above, a counter of the task below.
_TASK_BITS = 40

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths that fills a window closest to its capacity: length -> count.

    The longest length always takes part, so that large pieces do not pile up. For the
    rest, bit i of `reach` says that some of the lengths seen so far add up to i; each
    length contributes at most its count. The way back subtracts lengths again.
    Equal sums are settled for fewer, longer pieces.
    """
    first = max(counts)
    room = capacity - first
    chosen = {first: 1}
    if room <= 0:
        return chosen
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most = min(counts[length] - (length == first), room // length)
        before = reach
        taken, step = 0, 1
        while taken < most:
            step = min(step, most - taken)
            reach |= (reach << (length * step)) & mask
            taken += step
            step *= 2
        steps.append((length, most, before))
        if reach & goal:
            break
    at = reach.bit_length() - 1
    for length, most, before in reversed(steps):
        used = 0
        while not before >> at & 1:
            at -= length
            used += 1
            if at < 0 or used > most:
                raise AssertionError("a reached sum has no way back")
        if used:
            chosen[length] = chosen.get(length, 0) + used
    return chosen


class Packer:
    """Packs what it is given window by window; state: the ids not yet placed."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.waiting: dict[int, list[tuple]] = {}  # length -> [(doc_id, start, total, ids)]
        self.held = 0
        self.rows: list[tuple] = []

    def _place(self, piece: tuple, length: int, sequence: int, offset: int) -> None:
        doc, start, total, ids = piece
        self.rows.append((doc, start, length, zlib.crc32(memoryview(ids)[:4 * length]), total,
                          sequence, offset))

    def _wait(self, piece: tuple) -> None:
        length = len(piece[3]) // 4
        self.waiting.setdefault(length, []).append(piece)
        self.held += length

    def add(self, doc, ids: bytes) -> None:
        """Whole windows of a long document go out at once; its rest waits."""
        total, start = len(ids) // 4, 0
        while total - start >= self.capacity:
            self._place((doc, start, total, ids[4 * start:4 * (start + self.capacity)]),
                        self.capacity, self.next, 0)
            self.next += 1
            start += self.capacity
        if start < total:
            self._wait((doc, start, total, ids[4 * start:]))

    def _take(self, length: int) -> tuple:
        pieces = self.waiting[length]
        piece = pieces.pop()
        if not pieces:
            del self.waiting[length]
        self.held -= length
        return piece

    def pack(self, keep: int) -> None:
        """Fill windows until at most `keep` ids wait; a last, partly filled one only for keep = 0."""
        while self.waiting and self.held > keep:
            counts = {length: len(pieces) for length, pieces in self.waiting.items()}
            chosen = fill_window(counts, self.capacity)
            # The same choice fills further windows as long as its lengths last.
            for _ in range(min(counts[x] // n for x, n in chosen.items())):
                at = 0
                for length, n in chosen.items():
                    for _ in range(n):
                        self._place(self._take(length), length, self.next, at)
                        at += length
                if at < self.capacity and self.waiting:
                    # No choice is exact: cut the longest piece, which is longer than the slack.
                    length = max(self.waiting)
                    if length > self.capacity - at:
                        doc, start, total, ids = self._take(length)
                        cut = self.capacity - at
                        self._place((doc, start, total, ids), cut, self.next, at)
                        self._wait((doc, start + cut, total, ids[4 * cut:]))
                self.next += 1
                if not all(len(self.waiting.get(x, ())) >= n for x, n in chosen.items()):
                    break

    def drain(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        if not rows:
            return None
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   lookahead: int = LOOKAHEAD_IDS) -> DataFrame:
    """Cut documents into pieces and lay them into windows of `capacity` ids.

    One pass without a shuffle: each task packs the documents it reads, with at most
    `lookahead` ids waiting, so memory does not grow with the task. Long documents fill
    whole windows; the rest of each document waits until minimum bin slack picks it.
    When no choice of waiting pieces is exact, the longest is cut. Only the last window
    of a task can be short. A window never mixes documents of two tasks.

    NULL and empty texts are documents of `end_id` alone; repeated rows and NULL doc_ids
    are packed like any other row; no documents give no pieces; other columns are ignored.
    """
    path = tokenizer or vocabulary("word_bpe_49k.json")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = word_encoder(path), None
        for batch in chunks(batches, "text"):
            if packer is None:
                packer = Packer(capacity, batch.column("part")[0].as_py() << _TASK_BITS)
            ids = encoder.encode(batch.column("text"))
            for doc, own in zip(batch.column("doc_id").to_pylist(), ids):
                packer.add(doc, own + end)
                if packer.held > lookahead:
                    packer.pack(lookahead // 2)
                    yield packer.drain()
        if packer:
            packer.pack(0)
            if (last := packer.drain()) is not None:
                yield last

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                      F.spark_partition_id().cast("long").alias("part"))
    return own.transform(in_arrow, run, PIECES)
