"""Exact top-k search with BM25: sharded inverted index and block-max pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm.base import chunks, in_arrow, settle

K1, B = 1.2, 0.75
# Documents of a shard and of a block within it, and postings that close a shard earlier.
SHARD_DOCS, BLOCK_DOCS = 8_192, 256
SHARD_POSTINGS = 2_000_000
# Shards that a task holds while the queries pass, and the share of their groups (one in so many) that a query meets first.
GROUP_SHARDS, HOME_SHARE = 4, 16
# Runs whose largest weights are found at once.
_RUNS = 65_536
# Most frequent terms of a shard, kept as a matrix of weights by document, and queries that meet it at once.
COMMON_TERMS, QUERY_BLOCK = 512, 256
# Relative error, at most, of single precision sums over that many terms (all positive).
_ROUGH = 1e-4
# Postings of candidates that are scored at once, and of rare terms that are summed at once.
_SCORED, _SUMMED = 262_144, 32_768

_FIELDS = ["ids", "lengths", "terms", "ends", "postings", "counts"]


def term_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct terms (64 bit hashes, ascending), their counts, and the number of words of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64), 0
    terms, counts = np.unique(np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64), return_counts=True)
    return terms, counts, len(words)


def build_shard(ids: list[int], found: list[tuple]) -> list[bytes]:
    """Inverted lists of some documents as byte columns (see _FIELDS).

    Documents are laid out by their most frequent term, so that neighbours are alike and
    the maxima of a block are tight.
    """
    main = np.array([t[np.argmax(c)] if len(t) else 0 for t, c, _ in found], np.uint64)
    order = np.lexsort((np.array([n for _, _, n in found]), main))
    terms = np.concatenate([found[i][0] for i in order])
    counts = np.concatenate([found[i][1] for i in order])
    counts = counts.astype(np.min_scalar_type(counts.max(initial=0)))   # mostly one byte each
    doc = np.repeat(np.arange(len(order)), [len(found[i][0]) for i in order]).astype(np.uint16)
    by_term = np.argsort(terms, kind="stable")
    different, first = np.unique(terms[by_term], return_index=True)
    ends = np.concatenate([first[1:], [len(terms)]]).astype(np.int64) if len(terms) else np.empty(0, np.int64)
    return [x.tobytes() for x in (np.array(ids, np.int64)[order], np.array([found[i][2] for i in order], np.int64), different, ends,
                                  doc[by_term], counts[by_term])]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _sorted_terms(pairs: str, field: str):
    return F.transform(pairs, lambda x: x[field])


class Asked:
    """Some queries (terms, ascending, and their idf) side by side: each different term is looked up once in a shard."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]]):
        self.count, sizes = len(queries), [len(terms) for terms, _ in queries]
        self.query, self.ends = np.repeat(np.arange(self.count), sizes), np.cumsum([0, *sizes])
        self.idf = np.concatenate([idf for _, idf in queries])
        self.different, self.which = np.unique(np.concatenate([terms for terms, _ in queries]), return_inverse=True)


class Shard:
    """A shard in memory: postings by term and by document, the largest weight of each term in each block,
    and the weights of the most frequent terms as a matrix in single precision, which only bounds scores."""

    def __init__(self, row: dict, average: float):
        kinds = (np.int64, np.int64, np.uint64, np.int64, np.uint16)
        self.ids, lengths, self.terms, self.ends, self.doc = (np.frombuffer(row[f], k) for f, k in zip(_FIELDS, kinds))
        self.counts = np.frombuffer(row["counts"], f"<u{row['counts'].size // max(1, len(self.doc)) or 1}")
        self.norm = K1 * (1 - B + B * lengths / max(average, 1e-9))
        self.blocks = -(-len(self.ids) // BLOCK_DOCS)
        block = self.doc // BLOCK_DOCS
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        new[self.ends[:-1]] = True
        self.run_start = np.append(np.flatnonzero(new), len(block)).astype(np.int32)    # and the end of the last
        self.run_block = block[self.run_start[:-1]]
        self.run_max = np.empty(len(self.run_block))
        for low in range(0, len(self.run_block), _RUNS):
            bounds = self.run_start[low:low + _RUNS + 1]
            weights = self._weights(slice(bounds[0], bounds[-1]))
            self.run_max[low:low + _RUNS] = np.maximum.reduceat(weights, bounds[:-1] - bounds[0])
        self.run_end = np.searchsorted(self.run_start, self.ends)
        sizes = np.diff(self.ends, prepend=0)
        common = np.sort(np.argsort(-sizes, kind="stable")[:COMMON_TERMS])
        self.common = np.full(len(sizes), -1, np.int16)     # the matrix' row of a term, or -1
        self.common[common] = np.arange(len(common))
        matrix = np.zeros((len(common), len(self.ids)), np.float32)
        self.rough = np.empty(len(self.doc), np.float32)    # weights of all postings, in single precision
        for low in range(0, len(self.doc), _SCORED):
            self.rough[low:low + _SCORED] = self._weights(slice(low, low + _SCORED))
        for row, term in enumerate(common):
            spots = slice(self.ends[term] - sizes[term], self.ends[term])
            matrix[row, self.doc[spots]] = self.rough[spots]
        self.tiles = []                                     # of each block: the matrix' rows with weights in it, and these
        self.common_max = np.zeros((len(common), self.blocks), np.float32)
        for block in range(self.blocks):
            tile = matrix[:, block * BLOCK_DOCS:(block + 1) * BLOCK_DOCS]
            self.common_max[:, block] = tile.max(axis=1, initial=0)
            rows = np.flatnonzero(self.common_max[:, block])
            self.tiles.append((rows, tile[rows]))
        self.by_doc = np.argsort(self.doc, kind="stable").astype(np.int32)      # terms ascend within a document
        self.term_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[self.by_doc]
        self.asked_at = np.full(len(sizes), -1, np.int32)   # number of a term in the query that is scored, or -1
        self.doc_ends = np.cumsum(np.bincount(self.doc, minlength=len(self.ids)))

    def _weights(self, spots) -> np.ndarray:
        """Weights of some postings, without their terms' idf; made when needed, as they take eight bytes each."""
        counts = self.counts[spots].astype(np.float64)
        return counts * (K1 + 1) / (counts + self.norm[self.doc[spots]])

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """`best` for one query of terms and their idf."""
        return self.best(Asked([(terms, idf)]), k, np.array([floor]))[0]

    def best(self, asked: Asked, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(doc_id, score) of the best k documents that hold a term, for each query; equal scores at the end are all kept.

        A floor is a score that k documents of other shards are known to reach; lower ones may be left out.

        Blocks whose bound, the sum of their terms' largest weights, is below the floor are skipped. In the
        others common terms are summed as matrix products and the postings of rare terms are added. That
        tells each score but for rounding; documents that may be among the best are then scored exactly,
        term by term.
        """
        nothing = np.empty(0, np.int64), np.empty(0)
        if not len(self.terms):
            return [nothing] * asked.count
        n, docs = asked.count, len(self.ids)
        place = np.minimum(np.searchsorted(self.terms, asked.different), len(self.terms) - 1)
        here = self.terms[place] == asked.different
        row = np.where(here, self.common[place], -1)[asked.which]
        wants = np.zeros((n, len(self.common_max)), np.float32)
        wants[asked.query[row >= 0], row[row >= 0]] = asked.idf[row >= 0]
        rare = np.flatnonzero((row < 0) & here[asked.which])
        at = place[asked.which[rare]]
        first = np.where(at > 0, self.run_end[at - 1], 0)
        sizes = self.run_end[at] - first
        runs, asks, gain = _ranges(first, sizes), np.repeat(asked.query[rare], sizes), np.repeat(asked.idf[rare], sizes)
        spot = asks * self.blocks + self.run_block[runs]
        bound = np.bincount(spot, weights=gain * self.run_max[runs], minlength=n * self.blocks).reshape(n, -1) + wants @ self.common_max
        is_open = (bound > 0) & (bound * (1 + _ROUGH) >= floors[:, None])
        left = np.flatnonzero(is_open.ravel()[spot])
        about = self._rare_sums(runs[left], asks[left], gain[left], n)
        for block, (rows, tile) in enumerate(self.tiles):
            some = np.flatnonzero(is_open[:, block])
            if len(some):
                some = slice(None) if len(some) == n else some
                low = block * BLOCK_DOCS
                about[some, low:low + tile.shape[1]] += wants[some][:, rows] @ tile
        spots = np.flatnonzero(about >= np.maximum(floors * (1 - _ROUGH), 1e-300)[:, None])
        about = about.ravel()[spots]
        ends = np.searchsorted(spots, np.arange(n + 1) * docs)
        out = [nothing] * n
        for q in np.flatnonzero(np.diff(ends)):
            maybe, rough = spots[ends[q]:ends[q + 1]] - q * docs, about[ends[q]:ends[q + 1]]
            if len(maybe) > k:
                least = np.partition(rough, len(rough) - k)[len(rough) - k] * (1 - _ROUGH)
                maybe = maybe[rough * (1 + _ROUGH) >= least]
            mine = slice(asked.ends[q], asked.ends[q + 1])
            held = here[asked.which[mine]]
            score = self._scores(maybe, place[asked.which[mine][held]], asked.idf[mine][held])
            if len(score) > k:
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                maybe, score = maybe[keep], score[keep]
            out[q] = self.ids[maybe], score
        return out

    def _rare_sums(self, runs: np.ndarray, asks: np.ndarray, gain: np.ndarray, n: int) -> np.ndarray:
        """Queries x documents: the sums of some runs' postings, each with its query and gain; runs of a query are neighbours."""
        docs = len(self.ids)
        out = np.zeros(n * docs)
        starts = self.run_start[runs].astype(np.int64)
        sizes = self.run_start[runs + 1] - starts
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, _SUMMED), "right")
        for low, high in zip(cuts, [*cuts[1:], len(runs)]):
            if low < high:
                from_, to = asks[low] * docs, (asks[high - 1] + 1) * docs
                spots = _ranges(starts[low:high], sizes[low:high])
                key = self.doc.take(spots, mode="clip") + np.repeat(asks[low:high] * docs - from_, sizes[low:high])
                gained = self.rough.take(spots, mode="clip") * np.repeat(gain[low:high], sizes[low:high])
                out[from_:to] += np.bincount(key, weights=gained, minlength=to - from_)
        return out.reshape(n, docs)

    def _scores(self, docs: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Exact scores of some documents: their own postings, those of the query's terms, in the order of terms."""
        self.asked_at[at] = np.arange(len(at))
        first = np.where(docs > 0, self.doc_ends[docs - 1], 0)
        sizes = self.doc_ends[docs] - first
        piece = np.cumsum(sizes) // _SCORED
        out = []
        for one in np.unique(piece):
            some = np.flatnonzero(piece == one)
            spots = _ranges(first[some], sizes[some])
            term = self.asked_at[self.term_of[spots]]
            mine = np.flatnonzero(term >= 0)
            doc = np.repeat(np.arange(len(some)), sizes[some])[mine]
            out.append(np.bincount(doc, weights=self._weights(self.by_doc[spots[mine]]) * idf[term[mine]], minlength=len(some)))
        self.asked_at[at] = -1
        return np.concatenate(out) if out else np.empty(0)


def _index(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row for each shard: its postings and totals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, postings = [], [], 0

        def flush():
            lengths = [n for _, _, n in found]
            columns = [[len(ids)], [sum(lengths)], *([x] for x in build_shard(ids, found))]
            kinds = [pa.int64(), pa.int64()] + [pa.binary()] * len(_FIELDS)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["docs", "words", *_FIELDS])

        for batch in chunks(batches, "text"):
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                found.append(term_hashes(t))
                postings += len(found[-1][0])
                if len(ids) == SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield flush()
                    ids, found, postings = [], [], 0
        if ids:
            yield flush()
    built = docs.transform(in_arrow, run, "docs long, words long, " + ", ".join(f"{f} binary" for f in _FIELDS))
    return built.withColumn("shard", F.monotonically_increasing_id())


def search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id",
           query_text: str = "text", k: int = 10) -> DataFrame:
    """The k documents with the largest BM25 score for each query: query_id, rank, doc_id, score.

    Words are lower-cased (A-Z) runs without ASCII white space; a query is the set of the
    words of its whole text. Document frequencies, number and mean length are those of
    all documents, so every shard scores alike and the union of the shards' results holds
    the exact answer. Queries meet every group of GROUP_SHARDS shards: first one in HOME_SHARE of the
    groups, other ones for each query, and with the k-th best score found there all the rest. What a task
    holds is one group and one batch of queries, cut by its bytes, and the scores found in one shard of a
    group prune the next. Only documents that share a word are found; ties go to the smaller doc_id.

    NULL and empty texts are documents of length 0 that nothing finds, and queries
    without results; NULL doc_ids are left out; repeated rows are documents (queries) of
    their own, a repeated query_id is answered once, by its first text; no rows give no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    shards = settle(_index(own), "shards")
    total, words, count = shards.agg(F.sum("docs"), F.sum("words"), F.count("*")).first()
    if not total:
        return docs.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    average = words / total

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [term_hashes(t)[0].view(np.int64) for t in batch.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), pa.array(np.concatenate(found))], ["query_id", "term"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["terms"], np.int64)),
                                                  pa.array(np.diff(np.frombuffer(row["ends"], np.int64), prepend=0))], ["term", "df"])

    asked = (queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_text).cast("string").alias("text")).where("query_id is not null")
             .groupBy("query_id").agg(F.min("text").alias("text")))
    asked = settle(asked.transform(in_arrow, terms_of, "query_id long, term long"), "terms")
    wanted = asked.select("term").distinct()
    df = (shards.select("terms", "ends").transform(in_arrow, frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
          .join(wanted, "term"))
    weighted = settle(asked.join(df, "term").groupBy("query_id")
                      .agg(F.sort_array(F.collect_list(F.struct(F.col("term"), F.col("df")))).alias("pairs"))
                      .select("query_id", _sorted_terms("pairs", "term").alias("terms"), _sorted_terms("pairs", "df").alias("dfs")), "weights")
    # Every query goes to every group of shards. A group's shards come first, the queries after them.
    numbers = shards.select("shard", F.expr(f"(row_number() OVER (ORDER BY shard) - 1) div {GROUP_SHARDS}").alias("batch"))
    groups = -(-count // GROUP_SHARDS)
    homes = -(-groups // HOME_SHARE)
    each = _one_partition_each(docs.sparkSession, groups)
    all_groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    steps = F.pmod(F.col("batch") - F.xxhash64("query_id"), F.lit(groups))      # from the query's first group
    asks = weighted.select(all_groups.alias("batch"), F.lit(1).alias("part"), "query_id", "terms", "dfs")
    alike = F.get("terms", F.array_position("dfs", F.array_max("dfs")).cast("int") - 1)     # queries of a most frequent term open the same blocks
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in weighted.select("query_id", "terms", "dfs").schema]
    held = shards.join(F.broadcast(numbers) if count <= 100_000 else numbers, "shard").select(
        "batch", F.lit(0).alias("part"), *none, F.lit(0.0).alias("floor"), *[F.col(f).alias(f"shard_{f}") for f in _FIELDS])

    def answered(asks: DataFrame) -> DataFrame:
        dealt = held.unionByName(asks, allowMissingColumns=True).withColumn("place", F.get(F.lit(each), F.col("batch").cast("int")).cast("long"))
        return (dealt.repartition(groups, "place").sortWithinPartitions("batch", "part", alike)
                .transform(in_arrow, answer, "query_id long, doc_id long, score double"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            asked, out = [], []

            def flush():
                floors, best = np.array([q[1] for q in asked]), [(np.empty(0, np.int64), np.empty(0))] * len(asked)
                met = Asked([q[2:] for q in asked]) if asked else None
                for shard in held if asked else []:
                    for i, more in enumerate(shard.best(met, k, floors)):
                        if len(more[0]):
                            found, score = (np.concatenate(c) for c in zip(best[i], more))
                            if len(found) >= k:
                                top = np.lexsort((found, -score))[:k]
                                found, score = found[top], score[top]
                                floors[i] = max(floors[i], score[-1])
                            best[i] = found, score
                out.extend((np.full(len(found), q[0], np.int64), found, score) for q, (found, score) in zip(asked, best))
                asked.clear()

            for i, (part, number, q, floor) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "batch", "query_id", "floor")))):
                if part == 0:
                    if number != group:
                        flush()
                        held, group = [], number  # one group at a time
                    held.append(Shard({f: batch.column(f"shard_{f}")[i].as_buffer() for f in _FIELDS}, average))
                    continue
                term = batch.column("terms")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                df = batch.column("dfs")[i].values.to_numpy(zero_copy_only=False)
                ascending = np.argsort(term)
                asked.append((q, floor, term[ascending], np.log1p((total - df + 0.5) / (df + 0.5))[ascending]))
                if len(asked) == QUERY_BLOCK:
                    flush()
            flush()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "doc_id", "score"])

    found = first = settle(answered(asks.where(steps < homes).withColumn("floor", F.lit(0.0))), "first")
    if homes < groups:
        known = first.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("floor"))
        rest = asks.where(steps >= homes).join(known, "query_id", "left").fillna(0.0, ["floor"])
        found = first.unionByName(answered(rest.select(*asks.columns, "floor")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def _one_partition_each(spark: SparkSession, groups: int) -> list[int]:
    """For each of some groups a number that Spark's hash partitioning deals to a partition of its own among so many."""
    spread = spark.range(groups * 100).groupBy(F.pmod(F.hash("id"), F.lit(groups)).alias("at")).agg(F.min("id").alias("id"))
    found = {r["at"]: r["id"] for r in spread.collect()}     # one that is missing shares a partition
    return [found.get(g, g) for g in range(groups)]
