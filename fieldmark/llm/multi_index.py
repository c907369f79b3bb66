"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.base import in_arrow, settle

# Vectors the two codebooks are fitted on at most: those with the least hash of their id.
FIT_ROWS = 20_000
# Centroids of each half: the index has CENTROIDS ** 2 cells.
CENTROIDS = 16
# A query visits cells until they hold this share of the different vectors. Vectors without any
# clusters need more than half for a recall of 0.9 (see the README); clustered ones far less.
SHARE = 0.7
# Vectors and queries of a cell that meet in one block.
BLOCK_VECTORS, BLOCK_QUERIES = 2_048, 512
# Answers a task holds before it passes them on.
HELD_ANSWERS = 400_000


@dataclass
class MultiIndex:
    first: np.ndarray  # centroids of the first half, one per row
    second: np.ndarray

    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell number of each vector: the nearest centroid (Euclidean) of each half."""
        def code(part, book):
            return np.argmin((book * book).sum(1)[None, :] - 2 * part @ book.T, axis=1)
        return code(x[:, :self.half()], self.first) * len(self.second) + code(x[:, self.half():], self.second)

    def probe(self, query: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
        """Cells by decreasing summed inner product of their centroids, until they hold `wanted` vectors.

        Multi-sequence traversal: both halves' centroids are ranked, and a heap holds the
        frontier of centroid pairs. held: vectors of each cell.
        """
        a, b = self.first @ query[:self.half()], self.second @ query[self.half():]
        one, two = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, seen, out, got = [(-(a[one[0]] + b[two[0]]), 0, 0)], {(0, 0)}, [], 0
        while heap and got < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(one[i]) * len(two) + int(two[j])
            if held[cell]:
                out.append(cell)
                got += held[cell]
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(one) and y < len(two) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(a[one[x]] + b[two[y]]), x, y))
        return out


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means of the rows; fewer centroids if there are fewer different rows."""
    book = np.unique(x, axis=0)
    if len(book) <= k:
        return book
    book = book[rng.choice(len(book), k, replace=False)]
    for _ in range(rounds):
        code = np.argmin((book * book).sum(1)[None, :] - 2 * x @ book.T, axis=1)
        sums = np.zeros_like(book)
        np.add.at(sums, code, x)
        count = np.bincount(code, minlength=k)
        book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
    return book


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; all have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _leaders(query: np.ndarray, entry: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best entries and all that equal the last of them."""
    order = np.lexsort((-score, query))
    query, entry, score = query[order], entry[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    size = np.diff(first, append=len(query))
    last = np.repeat(score[first + np.minimum(size, k) - 1], size)
    keep = score >= last
    return query[keep], entry[keep], score[keep]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v), v of floats or doubles: without NULL ids, NULL, zero, empty vectors and those with NULL or non-finite components."""
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"))
            .where("vec_id is not null and v is not null").where(~bad & F.exists(v, lambda x: x != 0)))


def search(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20,
           centroids: int = CENTROIDS, share: float = SHARE, fit_rows: int = FIT_ROWS, seed: int = 7) -> DataFrame:
    """The k vectors with the largest inner product that the index finds for each query.

    is_query: condition on vec_id. Result: query_id, rank, vec_id, score (inner product
    of the original vectors in double precision); ties go to the smaller vec_id; a query
    is not its own neighbour.

    Equal vectors are one entry of the index (with their k + 1 least ids: no more can be
    in a result) and equal queries one search, so copies make no cell large. Entries of a
    cell are dealt into blocks, its queries too, and each pair of blocks is one matrix
    product. Only codebooks and entry counts of cells, both of fixed size, reach the
    driver. A query visits cells until they hold `share` of all entries and k + 1 at least.

    Vectors that `usable` leaves out take no part, as queries or as neighbours, nor do
    vectors whose length is not the most common one. A repeated vec_id is a row of its
    own; rows with a query's own vec_id are not its neighbours. No rows give no rows.
    """
    own = usable(vectors, vec_id, vector)
    widths = own.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], result)
    own = own.where(F.size("v") == widths["w"])

    # One entry for equal vectors. Two steps, so that a very common vector is thinned out first.
    salt = Window.partitionBy("v", "salt").orderBy("vec_id")
    whole = Window.partitionBy("v").orderBy("vec_id")
    least = (own.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("n", F.row_number().over(salt)).where(F.col("n") <= k + 1)
             .withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1))
    entries = settle(least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.xxhash64("v", "ids")), "entries")
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(fit_rows).select("v").collect()
    x = np.array([r["v"] for r in sample], np.float64)
    rng, half = np.random.default_rng(seed), (x.shape[1] + 1) // 2
    # A single component leaves the second half empty: one centroid without components.
    kind = dict(entries.dtypes)["v"]
    second = _codebook(x[:, half:], centroids, rng) if x.shape[1] > 1 else np.zeros((1, 0))
    index = MultiIndex(_codebook(x[:, :half], centroids, rng), second)
    cells = len(index.first) * len(index.second)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = index.cells(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(cell.astype(np.int32)), batch.column("v")],
                                                 ["entry", "cell", "v"])
    placed = settle(entries.select("entry", "v").transform(in_arrow, assign, f"entry long, cell int, v {kind}"), "cells")
    held = np.zeros(cells, np.int64)
    for r in placed.groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]
    wanted = max(k + 1, int(np.ceil(share * held.sum())))
    blocks = np.maximum(1, -(-held // BLOCK_VECTORS))

    def of_cell(values: np.ndarray, cell="cell"):
        return F.get(F.array(*[F.lit(int(x)) for x in values]), F.col(cell)) if values.max() > 1 else F.lit(1)

    # Equal queries are searched once; `ids` of all of them wait for the answer.
    asked = settle(own.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v")
                   .withColumn("query", F.xxhash64("v")), "queries")
    distinct = asked.select("query", "v").dropDuplicates(["query", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [index.probe(q, held, wanted) for q in _matrix(part.column("v"))]
                at = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(at)), pa.array(np.concatenate([*found, []]).astype(np.int32)),
                                                  part.column("v").take(pa.array(at))], ["query", "cell", "v"])
    probes = settle(distinct.transform(in_arrow, visit, f"query long, cell int, v {kind}"), "probes")
    asks = np.zeros(cells, np.int64)
    for r in probes.groupBy("cell").count().collect():
        asks[r["cell"]] = r["count"]
    rounds = np.maximum(1, -(-asks // BLOCK_QUERIES))

    vector_blocks = (placed.withColumn("block", F.pmod(F.xxhash64("entry"), of_cell(blocks)).cast("int"))
                     .groupBy("cell", "block").agg(F.collect_list(F.struct("v", "entry")).alias("entries")))
    query_blocks = (probes.withColumn("round", F.pmod(F.xxhash64("query"), of_cell(rounds)).cast("int"))
                    .groupBy("cell", "round").agg(F.collect_list(F.struct("query", "v")).alias("queries"))
                    .withColumn("block", F.explode(F.sequence(F.lit(0), of_cell(blocks).cast("int") - 1))))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back, count = [], 0

        def best():
            return _leaders(*(np.concatenate(c) for c in zip(*held_back)), k + 1)

        def out(columns):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "entry", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                some, asking = batch.column("entries").slice(i, 1).flatten(), batch.column("queries").slice(i, 1).flatten()
                v, q = _matrix(some.field("v")), _matrix(asking.field("v"))
                entry, query = (x.to_numpy(zero_copy_only=False) for x in (some.field("entry"), asking.field("query")))
                score = q @ v.T
                top = min(k + 1, len(v))
                last = -np.partition(-score, top - 1, axis=1)[:, top - 1]
                # all entries as good as the last one stay: ties are settled by id later
                row, col = np.nonzero(score >= (last - 1e-9 * np.maximum(1.0, np.abs(last)))[:, None])
                held_back.append((query[row], entry[col], np.einsum("ij,ij->i", q[row], v[col])))
                count += len(row)
                if count > HELD_ANSWERS:
                    held_back = [best()]
                    count = len(held_back[0][0])
                    if count > HELD_ANSWERS // 2:
                        yield out(held_back[0])
                        held_back, count = [], 0
        if held_back:
            yield out(best())

    found = (query_blocks.join(vector_blocks, ["cell", "block"]).select("entries", "queries")
             .transform(in_arrow, rerank, "query long, entry long, score double"))
    found = found.withColumn("n", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") <= k + 1)
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = (found.select("query", "entry", "score").join(entries.select("entry", "ids"), "entry")
               .select("query", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1))
    answers = settle(answers.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near")), "answers")
    # k + 1 answers and at most one of them is the query itself.
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (asked.select("query_id", "query").join(answers, "query").select("query_id", F.posexplode(others).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")))
