"""Importance resampling towards a target distribution of hashed word runs.

A feature is a run of 1 to `longest` consecutive words; its bucket is the CRC-32 of its
bytes modulo `buckets`. The gain of a bucket compares its smoothed share in the target
texts with its share in the corpus, a document's weight is the sum of its gains, and
the weight plus Gumbel noise of the id is the score by which documents are drawn
without replacement. Words are runs of ASCII letters and digits (A-Z lower-cased) and
all other non-ASCII characters.

CRC-32 is linear over XOR: the checksum of a span is the XOR of one value for each
byte, looked up by the byte and its distance from the span's end, and of a constant for
the span's length. So all spans of a batch are one gather and one bitwise_xor.reduceat.
Spans longer than the table are cut into blocks from their end and folded block by block.

NULL and empty texts have no features, weight 0, and are drawn only if `least_words` is 0.
Repeated rows are documents of their own, with equal scores; ties go to the smaller
doc_id, a NULL id (noise of an empty id) last. Empty tables give no rows; an empty target
is the uniform distribution. Only the named columns are read, so others may have any name.
Texts may be of any length: they pass in pieces cut between words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.base import chunks, in_arrow, settle, worker_state
from fieldmark.operators.ordered import row_numbers

BUCKETS = 10_000
BLOCK = 64            # bytes from a span's end that the table covers
PIECE = 1 << 20       # bytes of text handled at once
ROWS_PER_SEGMENT = 50_000


class Crc:
    """CRC-32 (reflected polynomial 0xEDB88320) of many spans at once."""

    def __init__(self, block: int = BLOCK):
        first = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            first = np.where(first & 1, (first >> 1) ^ np.uint32(0xEDB88320), first >> 1)
        rows = [first]
        for _ in range(block - 1):
            rows.append((rows[-1] >> 8) ^ first[rows[-1] & 0xFF])
        self.block = block
        self.table = np.concatenate(rows)                     # [distance * 256 + byte]
        self.constant = np.array([zlib.crc32(bytes(n)) for n in range(block + 1)], dtype=np.uint32)

    def _linear(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """XOR of the contributions of each span; sizes of 1 to block bytes."""
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum()), dtype=np.int64)
        byte = data[at + np.repeat(start - first, size)]
        distance = np.repeat(first + size - 1, size) - at
        return np.bitwise_xor.reduceat(self.table[(distance << 8) + byte], first)

    def _past_block(self, value: np.ndarray) -> np.ndarray:
        """The register after a further block of zero bytes."""
        out = np.zeros_like(value)
        for k in range(4):
            out ^= self.table[((self.block - 1 - k) << 8) + ((value >> (8 * k)) & 0xFF)]
        return out

    def _length_constant(self, size: int) -> int:
        return int(self.constant[size]) if size <= self.block else zlib.crc32(bytes(size))

    def of(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Checksums of data[start:start + size], sizes of at least 1."""
        out = np.empty(len(start), dtype=np.uint32)
        short = size <= self.block
        if short.any():
            s = size[short]
            out[short] = self._linear(data, start[short], s) ^ self.constant[s]
        if not short.all():
            at = np.flatnonzero(~short)
            s, begin = size[at], start[at]
            head = (s - 1) % self.block + 1                    # the first, perhaps shorter block
            value = self._linear(data, begin, head)
            begin, rest = begin + head, (s - head) // self.block
            while (open_ := np.flatnonzero(rest > 0)).size:
                block = self._linear(data, begin[open_], np.full(open_.size, self.block))
                value[open_] = self._past_block(value[open_]) ^ block
                begin[open_] += self.block
                rest[open_] -= 1
            lengths, which = np.unique(s, return_inverse=True)
            constants = np.array([self._length_constant(int(n)) for n in lengths], dtype=np.uint32)
            out[at] = value ^ constants[which]
        return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, int, np.ndarray, bool]]:
    """(bytes, first row, offsets of the rows, whether they go on the row before): whole rows, very long ones cut between words."""
    raw = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1]
    buffer = raw.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(raw):
        until = int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1
        if until > row:
            yield data[offsets[row]:offsets[until]], row, offsets[row:until + 1] - offsets[row], False
            row = until
            continue
        at, end = int(offsets[row]), int(offsets[row + 1])
        while at < end:
            cut = min(at + PIECE, end)
            while cut < end and _IN_WORD[data[cut]]:
                near = np.flatnonzero(~_IN_WORD[data[cut:min(cut + PIECE, end)]])
                cut = cut + int(near[0]) if near.size else min(cut + PIECE, end)
            yield data[at:cut], row, np.array([0, cut - at], dtype=np.int64), at > offsets[row]
            at = cut
        row += 1


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words, each followed by one space: (bytes, start of each word, piece of each word)."""
    inside = _IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]             # texts without a separator between them
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = end - start
    new = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _LOWER[data[inside]]
    return out, new, np.searchsorted(offsets, start, side="right") - 1


def features(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(row of each word, None) and (row, bucket of each feature) for the pieces of a batch."""
    crc = worker_state(f"crc{BLOCK}", Crc)
    tail = np.zeros(0, dtype=np.uint8)                        # the last words of a row that goes on
    for data, first, offsets, goes_on in _pieces(texts):
        joined, start, owner = _words(data, offsets)
        old = 0
        if goes_on and len(tail):
            old = int((tail == 32).sum())
            ends = np.flatnonzero(tail == 32)
            start = np.concatenate([np.append(0, ends[:-1] + 1), start + len(tail)])
            owner = np.concatenate([np.zeros(old, owner.dtype), owner])
            joined = np.concatenate([tail, joined])
        yield owner[old:] + first, None
        after = np.append(start[1:], len(joined)) if len(start) else start
        for n in range(1, min(longest, len(start)) + 1):
            begin, end = start[:len(start) - n + 1], after[n - 1:] - 1
            whole = owner[:len(begin)] == owner[n - 1:]       # within one text, and not all of it met before
            whole[:max(0, old - n + 1)] = False
            begin, end, of_row = begin[whole], end[whole], owner[:len(begin)][whole] + first
            step = max(1, PIECE // n // 8)                    # bounds the bytes gathered at once
            for i in range(0, len(begin), step):
                j = i + step
                yield of_row[i:j], crc.of(joined, begin[i:j], end[i:j] - begin[i:j]).astype(np.int64) % buckets
        keep = min(longest - 1, len(start))
        tail = joined[start[len(start) - keep]:] if keep else joined[:0]


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts in each bucket; a task sends one row for each bucket it met."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in chunks([batch], "text"):
                for _, hashed in features(part.column(0), longest, buckets):
                    if hashed is not None:
                        total += np.bincount(hashed, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    counted = in_arrow(texts.select(F.col(text).cast("string").alias("text")), count, "bucket long, n long")
    out = [0] * buckets
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():     # at most `buckets` rows
        out[bucket] = n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of smoothed shares of each bucket, rounded down."""
    k, s_all, t_all = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log((float(t + 1) * float(s_all + k)) / (float(s + 1) * float(t_all + k))))
            for s, t in zip(corpus, target)]


def weigh(docs: DataFrame, gain: list[int], text: str = "text", longest: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + n_words, n_features, weight of every document."""
    values = np.array(gain, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], "__text"):
                last, rows = len(part.schema) - 1, part.num_rows
                words, found, weight = (np.zeros(rows, dtype=np.int64) for _ in range(3))
                for owner, hashed in features(part.column(last), longest, len(values)):
                    n = np.bincount(owner, minlength=rows)
                    if hashed is None:
                        words += n
                    else:
                        found += n
                        # Sums of whole numbers far below 2 ** 53 are exact in doubles.
                        weight += np.bincount(owner, weights=values[hashed], minlength=rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(words), pa.array(found), pa.array(weight)],
                                                 [*part.schema.names[:last], "n_words", "n_features", "weight"])

    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*narrow.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])
    return in_arrow(narrow, run, schema)


def noise(doc_id, seed: int):
    """Thousandths of Gumbel noise from the hash of seed and id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1,
             buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20,
             rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Every document with doc_id, n_features, weight, score, rank; rank is NULL where the document is not drawn.

    Drawn are floor(percent * N / 100) of the N documents of at least `least_words` words, by
    falling score. Scores above a cut, verified by an exact count, are put in order in segments.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    scored = weigh(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), gain, "text", longest)
    scored = settle(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    fit = F.col("n_words") >= least_words
    share = 1 - percent / 100
    asked = [max(0.0, share - slack) for slack in (0.001, 0.01, 0.1)]
    n, cuts = scored.agg(F.count_if(fit), F.percentile_approx(F.when(fit, F.col("score")), asked, 10_000)).first()
    wanted = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    above = scored.agg(*[F.count_if(fit & (F.col("score") >= c)) for c in cuts]).first()
    cut = next((c for c, m in zip(cuts, above) if m >= wanted), None)
    chosen = fit if cut is None else fit & (F.col("score") >= cut)
    order = {"a": -F.col("score"), "b": F.col("doc_id").isNull(), "c": F.col("doc_id"), "d": F.col("n_features"), "e": F.col("weight"),
             "one": F.lit(0)}
    ranked = row_numbers(scored.where(chosen).withColumns(order), ["one"], ["a", "b", "c", "d", "e"], "rank", rows_per_segment)
    ranked = ranked.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank")))
