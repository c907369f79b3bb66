"""Exact Jaccard join of word n-gram sets with prefix filters under several token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.base import broadcast_if, chunks, in_arrow, named
from fieldmark.llm.components import components
from fieldmark.session import discard
from fieldmark.session import settle_lean as settle

WORDS = 5
PERCENT = 80

# Shingles met in at least SAMPLE_COUNT of the sampled documents (one of SAMPLE_SHARE) come last
# in every order, at most FREQUENT of them. Any order is right; this one keeps passages that
# many documents share out of the prefixes.
SAMPLE_SHARE, SAMPLE_COUNT, FREQUENT = 8, 3, 262_144
# Sets of each token that all others of the token are compared with first.
LEADERS = 4

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LAST = np.uint64(1 << 62)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bit numbers (the splitmix finaliser), so it orders tokens anew."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes (62 bits) of a text's word n-grams, sorted.

    Words are runs of non-white ASCII bytes with A-Z lower-cased. A text with fewer
    words has one shingle, its whole sequence; without words it has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found)) >> 2], np.uint64)
    own = np.frombuffer(b"".join(map(xxhash.xxh64_digest, found)), np.uint64)
    n = len(own) - words + 1
    total = own[:n].copy()
    for k in range(1, words):
        total *= _MIX[0]
        total += own[k:k + n]
    total = np.sort(_mixed(total) >> np.uint64(2))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


class Frequent:
    """The shingles that come last (sorted), with a table that settles most look-ups."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.mask = np.uint64((1 << 22) - 1)
        self.hint = np.zeros(1 << 22, bool)
        self.hint[(self.tokens & self.mask).astype(np.int64)] = True

    def among(self, tokens: np.ndarray) -> np.ndarray:
        found = self.hint[(tokens & self.mask).astype(np.int64)]
        at = np.flatnonzero(found)
        if len(at):
            place = np.minimum(np.searchsorted(self.tokens, tokens[at]), len(self.tokens) - 1)
            found[at] = self.tokens[place] == tokens[at]
        return found


def prefix(tokens: np.ndarray, frequent: Frequent, second: bool = False, percent: int = PERCENT) -> np.ndarray:
    """Prefix of a set under a global order, as order keys (ascending, one for each token).

    The key is the token's hash (the second order mixes it again), frequent tokens behind
    all others. With n tokens, a partner shares at least ceil(n * percent / 100) of them,
    so the first n - that + 1 keys of both meet, under any order that all sets use.
    """
    keep = len(tokens) - -(-len(tokens) * percent // 100) + 1
    last = frequent.among(tokens)
    keys = _mixed(tokens) >> np.uint64(2) if second else tokens
    rare, common = keys[~last], keys[last] | _LAST
    if second:
        rare, common = np.sort(rare), np.sort(common)
    return rare[:keep] if len(rare) >= keep else np.concatenate([rare, common])[:keep]


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(flat))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(key, text) -> (key, tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), _longs(found)], ["key", "tokens"])
    return docs.select("key", "text").transform(in_arrow, run, "key long, tokens array<long>")


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(SAMPLE_SHARE)) == 0)
    kept = settle(_sets(sample, words).select(F.explode("tokens").alias("token")).groupBy("token").count()
                  .where(F.col("count") >= SAMPLE_COUNT).orderBy(F.desc("count"), "token").limit(FREQUENT).select("token"), "frequent")
    rows = kept.toPandas()
    discard(kept)
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def _digest(tokens: np.ndarray) -> int | None:
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def _prefixes(docs: DataFrame, words: int, percent: int, frequent) -> DataFrame:
    """(key, doc_id, text) -> (key, doc_id, n, set_id, first); set_id is NULL for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = Frequent(frequent.value)
        for batch in chunks(batches, "text"):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([_digest(x) for x in sets], pa.int64()),
                 _longs([prefix(x, last, False, percent) if len(x) else x for x in sets])], ["key", "doc_id", "n", "set_id", "first"])
    return docs.select("key", "doc_id", "text").transform(in_arrow, run, "key long, doc_id long, n long, set_id long, first array<long>")


def _whole(docs: DataFrame, words: int, percent: int, frequent) -> DataFrame:
    """(key, text) -> (set_id, second, tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = Frequent(frequent.value)
        for batch in chunks(batches, "text"):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(x) for x in sets], pa.int64()),
                 _longs([prefix(x, last, True, percent) if len(x) else x for x in sets]), _longs(sets)], ["set_id", "second", "tokens"])
    return docs.select("key", "text").transform(in_arrow, run, "set_id long, second array<long>, tokens array<long>")


def _sizes_fit(a, b, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _needed(na, nb, percent: int) -> Column:
    """Least number of common tokens of two similar sets."""
    return F.ceil(percent * (F.col(na) + F.col(nb)) / F.lit(100 + percent))


def _least_shared(na, nb, percent: int) -> Column:
    """A lower bound of the common prefix keys of two similar sets, from their sizes alone.

    One of the two prefixes is complete up to the smaller of their last keys, and what is
    left of that set is known. Concave, so over ranges of sizes the least value is at a corner.
    """
    return F.lit(percent) * (na + nb) / F.lit(100 + percent) - F.lit(percent) * F.greatest(na, nb) / F.lit(100)


def _may_reach(one: str, other: str, na: str, nb: str, percent: int) -> Column:
    """Whether two prefixes under one order allow enough common tokens.

    Up to the smaller of their last keys both prefixes are complete: what is common there
    is known, and beyond it at most the shorter remainder can be common.
    """
    upto = F.least(F.element_at(one, -1), F.element_at(other, -1))
    rest = lambda keys, n: F.col(n) - F.size(F.filter(keys, lambda x: x <= upto))
    common = F.size(F.array_intersect(one, other))
    return (common > 0) & (common + F.least(rest(one, na), rest(other, nb)) >= _needed(na, nb, percent))


def _meet(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of both sets, as <column>_a and <column>_b."""
    side = lambda c: sets.select(F.col("set_id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    return docs.join(broadcast_if(wanted), "key", "left_semi")


def text_key(text: str) -> Column:
    """A hash of the text: with the doc_id it tells documents apart, also those that share one id."""
    return F.xxhash64(named(text).cast("string"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """Classes of documents linked by Jaccard similarity: key, doc_id, n_shingles, set_id, component_id, is_first.

    1. Each document's set, its digest (copies collapse to one set) and its prefix under
       the first order. 2. Of each prefix token met in several sets, the LEADERS sets whose
       prefixes are met elsewhere most are compared with all others. 3. Sets that are now
       connected need no more links between them; pairs of one token from different
       components are compared, all of them, so no link between components is lost.
       4. Components of all links.
    Comparing intersects filters: the sizes fit, the prefixes under the first order meet
    often enough for the needed overlap, those under the second order do too, and only
    then the whole sets decide.

    62 bit hashes are taken as unique. NULL, empty and blank texts have no shingles and
    are linked with nothing. component_id is the least doc_id of the component; NULL
    doc_ids take part but do not name a component. key is `text_key`; is_first marks the rows of
    the component's first document, told by doc_id and key: the least doc_id (NULL last), then the
    least key.
    Repeated rows are copies; no documents give no rows; other columns are ignored.
    """
    own = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    own = own.withColumn("key", text_key("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(own, words))
    flat = settle(_prefixes(own, words, percent, frequent), "prefixes")
    filled = flat.where("set_id is not null")
    copies = settle(filled.groupBy("set_id").agg(F.min("key").alias("key"), F.min("n").alias("n")), "copies")

    entries = filled.select(F.explode("first").alias("token"), "set_id")
    shared = (entries.groupBy("token").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"))
              .where("low < high").select("token"))
    shared = settle(entries.join(shared, "token", "left_semi").distinct(), "entries")
    # Sets whose prefixes are met elsewhere most are likely the middle of their group.
    central = shared.groupBy("set_id").count().join(copies, "set_id").select("set_id", "n", F.col("count").alias("met"), (F.col("count") / F.col("n")).alias("share"))
    entries = settle(shared.join(central, "set_id"), "entries")
    discard(shared)
    order = Window.partitionBy("token").orderBy(F.desc("share"), "set_id")
    leaders = (entries.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADERS)
               .select("token", F.col("set_id").alias("lead"), F.col("n").alias("lead_n"), F.col("met").alias("lead_met")))
    enough = F.least("met", "lead_met") >= _least_shared(F.col("n"), F.col("lead_n"), percent)
    tried = settle(entries.join(leaders, "token").where((F.col("set_id") != F.col("lead")) & _sizes_fit("n", "lead_n", percent) & enough)
                   .select(F.least("lead", "set_id").alias("a"), F.greatest("lead", "set_id").alias("b")).distinct(), "pairs")

    def heads_of(used: DataFrame) -> DataFrame:
        return filled.join(used, "set_id", "left_semi").select("set_id", "n", "first").dropDuplicates(["set_id"])

    def verify(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        heads = settle(heads_of(used), "heads")
        met = _meet(pairs, heads, ["n", "first"]).where(_may_reach("first_a", "first_b", "n_a", "n_b", percent))
        met = settle(met.select("a", "b", "n_a", "n_b"), "met")
        discard(heads)
        used = met.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        keys = settle(copies.join(used, "set_id").select("key"), "wanted")
        whole = settle(_whole(_with_texts(own, keys), words, percent, frequent).dropDuplicates(["set_id"]), "sets")
        both = _meet(met, whole, ["second", "tokens"]).where(_may_reach("second_a", "second_b", "n_a", "n_b", percent))
        overlap = F.size(F.array_intersect("tokens_a", "tokens_b"))
        linked = settle(both.where(100 * overlap >= percent * (F.col("n_a") + F.col("n_b") - overlap)).select("a", "b"), "verified")
        discard(met, keys, whole)
        return linked

    links = verify(tried)
    joined = settle(components(links), "components")

    # What is left: entries whose token still meets several components.
    placed = entries.select("token", "set_id", "n", "met").join(joined.withColumnRenamed("node", "set_id"), "set_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "set_id"))
    mixed = (placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low < high").select("token"))
    placed = settle(placed.join(mixed, "token", "left_semi"), "placed")
    groups = placed.groupBy("token", "component").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("met").alias("met"), F.count("*").alias("size"))
    discard(entries)
    groups = sizes = settle(groups, "groups")
    whole = groups.groupBy("component").agg(F.sum("size").alias("weight"), F.min("low").alias("least"), F.max("high").alias("most"))
    groups = groups.join(whole, "component")
    x, y = groups.alias("x"), groups.alias("y")
    # `one` is the smaller component, for all their tokens.
    meet = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.struct("x.weight", "x.component") < F.struct("y.weight", "y.component"))
                   & (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
                   & (F.least("x.met", "y.met") >= F.least(*[
                       _least_shared(F.col(f"x.{i}"), F.col(f"y.{j}"), percent) for i in ("low", "high") for j in ("low", "high")])))
            .select(F.col("x.token").alias("token"), F.col("x.component").alias("one"), F.col("y.component").alias("two"),
                    F.col("y.size").alias("size"), F.col("y.least").alias("least"), F.col("y.most").alias("most")))
    # A set shares no more tokens with any set of `two` than with all of them together.
    ones = placed.select("token", F.col("component").alias("one"), F.col("set_id").alias("p"), F.col("n").alias("n_p"))
    ones = settle(meet.join(ones, ["token", "one"]), "ones")
    discard(sizes)
    every = ones
    floor = F.least(*[_least_shared(F.col("n_p"), F.col(c), percent) for c in ("least", "most")])
    likely = (ones.groupBy("p", "two", "n_p", "least", "most").agg(F.count("*").alias("shared"))
              .withColumn("floor", F.greatest(F.lit(1), F.ceil(floor - 1e-6))).where("shared >= floor").select("p", "two", "shared", "floor"))
    # Of `shared` tokens a partner has at least `floor`, so it has one of any shared - floor + 1: the rarest.
    rare = Window.partitionBy("p", "two").orderBy("size", "token")
    ones = (ones.join(likely, ["p", "two"]).withColumn("place", F.row_number().over(rare)).where(F.col("place") <= F.col("shared") - F.col("floor") + 1)
            .select("token", "two", "p", "n_p"))
    ones = settle(ones, "ones")
    discard(every)
    twos = placed.select("token", F.col("component").alias("two"), F.col("set_id").alias("q"), F.col("n").alias("n_q"))
    twos = settle(twos.join(ones.select("token", "two").distinct(), ["token", "two"], "left_semi"), "twos")
    discard(placed)
    heads = settle(heads_of(ones.select(F.col("p").alias("set_id")).unionByName(twos.select(F.col("q").alias("set_id"))).distinct()), "heads")
    head = lambda c: heads.select(F.col("set_id").alias(c), F.col("first").alias(f"first_{c}"))
    # The filter of the first order is part of the join, so pairs that fail it are never rows.
    cross = (ones.join(head("p"), "p").join(twos.join(head("q"), "q"), ["token", "two"])
             .where(_sizes_fit("n_p", "n_q", percent) & _may_reach("first_p", "first_q", "n_p", "n_q", percent))
             .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    cross = settle(cross.join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(ones, twos, heads, tried)
    if not cross.isEmpty():
        joined = settle(components(links.unionByName(verify(cross))), "components")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    least = flat.where("set_id is not null").groupBy("set_id").agg(first)
    placed = least.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "set_id"))
    names = placed.groupBy("component").agg(F.min("first").alias("first"))
    known = placed.select("set_id", "component").join(names, "component").select("set_id", "first")
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return (flat.select("key", "doc_id", "n", "set_id").join(known, "set_id", "left")
            .select("key", "doc_id", F.col("n").alias("n_shingles"), "set_id",
                    F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
                    mine.alias("is_first")))
