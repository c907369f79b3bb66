"""How sources of a language differ in their use of terms, over terms of enough documents.

Terms are runs of ASCII letters (A-Z lower-cased) and all other non-ASCII characters. A
language keeps the terms that occur in at least `least` of its documents. They are found
by iceberg refinement of byte prefixes: at each level (4, 8, 16, ... bytes) the documents
with an open prefix (of longer terms) or with a term that ends within the level are
counted, but only below prefixes the level before has kept; prefixes and terms of fewer
documents are discarded. It ends when no open prefix is left.

A task sorts the distinct terms of each document and notes at how many levels a term
shares its prefix with the term before. So each document counts once for a prefix without
a shuffle of documents: the first term of a prefix stands for it.

Shares p are whole billionths, 1 + floor(1e9 * (count + 5) / (N + 5 * V)), in exact decimals.
Pairs of sources are compared over the terms they use: what the others add follows from
the shares of terms with count 0, which are one number for each source.

NULL text, lang and source are empty ones; rows without terms still make their group;
repeated rows are documents of their own; an empty table gives no rows; a lone source has
no pairs. Only the three named columns are read. Texts are taken whole, at any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.base import broadcast_if, chunks, in_arrow, settle

FIRST_LEVEL = 4       # bytes; each further level doubles it
LEAST_DOCUMENTS = 30
PIECE = 1 << 20       # bytes of text handled at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased terms of the texts data[offsets[i]:offsets[i + 1]], and the text of each."""
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = inside[cuts]
    start = np.flatnonzero(begins)
    letters = _LOWER[data[inside]]
    upto = np.cumsum(inside, dtype=np.int64)                   # letters up to and with each byte
    edges = np.append(upto[start] - 1, len(letters)).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(letters)])
    return found, np.searchsorted(offsets, start, side="right") - 1


def _ordered(found: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct terms in byte order, and the position of each given term among them."""
    coded = found.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)


def _shared_levels(terms: pa.Array, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For rows (text, term) in order: at how many levels the term is open and shares its prefix with the row before."""
    shared = np.zeros(len(rank), dtype=np.int32)
    sizes = pc.binary_length(terms).to_numpy()
    level = FIRST_LEVEL
    while len(sizes) and (long := np.flatnonzero(sizes > level)).size:
        prefix = pc.binary_slice(terms.take(pa.array(long)), 0, level)
        new = np.ones(len(long), dtype=bool)
        new[1:] = pc.not_equal(prefix.slice(1), prefix.slice(0, len(long) - 1)).to_numpy(zero_copy_only=False)
        group = np.full(len(sizes), -1, dtype=np.int64)
        group[long] = np.cumsum(new)
        mine = group[rank]
        shared[1:] += (text[1:] == text[:-1]) & (mine[1:] == mine[:-1]) & (mine[1:] >= 0)
        level *= 2
    return shared


def _as_lists(rows: int, terms: pa.Array, text: np.ndarray, rank: np.ndarray, counts: np.ndarray) -> pa.Array:
    shared = _shared_levels(terms, text, rank)
    values = pa.StructArray.from_arrays([terms.take(pa.array(rank)).cast(pa.binary()), pa.array(shared), pa.array(counts.astype(np.int64))],
                                        ["term", "shared", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(rows + 1)).astype(np.int32)), values)


def _term_lists(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, lists of the distinct terms with shared levels and counts) for runs of rows."""
    raw = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(raw):
        until = int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1
        if until > row:
            found, text = _terms(data[offsets[row]:offsets[until]], offsets[row:until + 1] - offsets[row])
            terms, rank = _ordered(found)
            keys, counts = np.unique(text * max(1, len(terms)) + rank, return_counts=True)
            yield row, _as_lists(until - row, terms, keys // max(1, len(terms)), keys % max(1, len(terms)), counts)
            row = until
            continue
        # One very long text: its terms are counted piece by piece, cut between terms.
        total: Counter = Counter()
        at, end = int(offsets[row]), int(offsets[row + 1])
        while at < end:
            cut = min(at + PIECE, end)
            while cut < end and _IN_TERM[data[cut]]:
                near = np.flatnonzero(~_IN_TERM[data[cut:min(cut + PIECE, end)]])
                cut = cut + int(near[0]) if near.size else min(cut + PIECE, end)
            counted = _terms(data[at:cut], np.array([0, cut - at]))[0].value_counts()
            total.update(dict(zip(counted.field(0).to_pylist(), counted.field(1).to_pylist())))
            at = cut
        terms = pa.array(sorted(total), pa.large_binary())
        yield row, _as_lists(1, terms, np.zeros(len(terms), np.int64), np.arange(len(terms)), np.array([total[t] for t in terms.to_pylist()]))
        row += 1


def term_lists(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, terms of every document: its distinct terms in byte order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], "text"):
                for first, lists in _term_lists(part.column(2)):
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(lists)), part.column(1).slice(first, len(lists)), lists],
                                                     ["lang", "source", "terms"])

    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    return in_arrow(docs.select(*named), run, "lang string, source string, terms array<struct<term:binary,shared:int,n:long>>")


def _below(rows: DataFrame, kept: DataFrame, on: list[str], group: list[str], value: Column) -> DataFrame:
    """Sums of rows whose `on` is kept. Kept sets counted to be small filter before the sum, others after it."""
    small = broadcast_if(kept)
    if small is not kept:
        return rows.join(small, on, "left_semi").groupBy(*group).agg(value.alias("n"))
    summed = rows.groupBy(*dict.fromkeys([*group, *on])).agg(value.alias("n"))
    return summed.join(kept, on, "left_semi").groupBy(*group).agg(F.sum("n").alias("n"))


def frequent_terms(lists: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) of the terms that occur in at least `least` documents of the language. Pass a settled table."""
    rows = lists.select("lang", F.explode("terms").alias("t")).select("lang", "t.term", "t.shared", F.octet_length("t.term").alias("size"))
    whole, kept, level, index = None, None, FIRST_LEVEL, 0
    while True:
        ends = F.col("size") <= level
        item = F.when(ends, F.col("term")).otherwise(F.substring("term", 1, level))
        here = rows.where(ends | (F.col("shared") <= index)).select("lang", item.alias("item"), ends.alias("ends"), "size",
                                                                    F.substring("term", 1, level // 2).alias("prefix"))
        if kept is None:
            counted = here.groupBy("lang", "item", "ends").agg(F.count(F.lit(1)).alias("n"))
        else:
            here = here.where(F.col("size") > level // 2)
            counted = _below(here, kept, ["lang", "prefix"], ["lang", "item", "ends"], F.count(F.lit(1)))
        found = settle(counted.where(F.col("n") >= least).select("lang", "item", "ends"), f"prefixes-{level}")
        ended = found.where("ends").select("lang", F.col("item").alias("term"))
        whole = ended if whole is None else whole.unionByName(ended)
        kept = found.where(~F.col("ends")).select("lang", F.col("item").alias("prefix"))
        if kept.isEmpty():
            return whole
        level, index = level * 2, index + 1


def _share(count, total, terms):
    """1 + floor(1e9 * (count + 5) / (total + 5 * terms)) in whole decimals; 1e9 * count may pass 64 bits."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")
    return F.expr("1L") + F.call_function("div", top, (total + 5 * terms).cast("decimal(20,0)"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    Part `pair`: each other source of the language, and the sum over all kept terms of the
    differences of the shares. Part `term`: terms the source uses more than its language,
    and the difference, only the first `top`. Rank by falling value, then by the item's bytes.
    """
    lists = settle(term_lists(docs, text, lang, source), "terms")
    # Terms and groups are numbers from here on: the wide sums and joins then move whole numbers only.
    kept = settle(frequent_terms(lists, least).withColumn("id", F.monotonically_increasing_id()), "kept")
    named = settle(lists.select("lang", "source").distinct().withColumn("of", F.monotonically_increasing_id()), "named")
    rows = lists.join(broadcast_if(named), ["lang", "source"]).select("lang", "of", F.explode("terms").alias("t")).select("lang", "of", "t.term", "t.n")
    small = broadcast_if(kept)
    if small is kept:       # kept terms beyond a broadcast: fewer rows go to the join when summed first
        rows = rows.groupBy("lang", "of", "term").agg(F.sum("n").alias("n"))
    counts = settle(rows.join(small, ["lang", "term"]).groupBy("of", "id").agg(F.sum("n").alias("n")), "counts")

    size = broadcast_if(settle(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "sizes"))
    used = counts.groupBy("of").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("used"))
    groups = named.join(used, "of", "left").join(size, "lang", "left").na.fill(0, ["total", "used", "terms"])
    zero = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(F.lit(0).cast("long"))
    groups = settle(groups.withColumn("zero", zero), "groups")
    small = broadcast_if(groups)
    shares = settle(counts.join(small.select("of", "total", "terms", "zero"), "of")
                    .select("of", "id", "zero", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "shares")

    # Pairs: all terms as if only one of the two used them, corrected for terms both use.
    pair = (groups.join(small.select("lang", F.col("of").alias("other"), F.col("source").alias("item"), F.col("zero").alias("other_zero"),
                                     F.col("used").alias("other_used")), "lang").where("of <> other"))
    pair = settle(pair.select("of", "other", "lang", "source", "item", "zero", "other_zero",
                              ((F.col("terms") - F.col("used") - F.col("other_used")) * F.abs(F.col("zero") - F.col("other_zero"))).alias("f")), "pairs")
    alone = (shares.groupBy("of", "p").agg(F.count(F.lit(1)).alias("n")).join(broadcast_if(pair.select("of", "other", "other_zero")), "of")
             .groupBy("of", "other").agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("other_zero"))).alias("f")))
    alone = settle(alone, "alone")
    theirs = shares.select("id", F.col("of").alias("other"), F.col("p").alias("q"), F.col("zero").alias("other_zero"))
    fix = (F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("other_zero")) - F.abs(F.col("zero") - F.col("q"))
           + F.abs(F.col("zero") - F.col("other_zero")))
    both = settle(shares.join(theirs, "id").where("of < other").groupBy("of", "other").agg(F.sum(fix).alias("f")), "both")
    swap = lambda df: df.select(F.col("other").alias("of"), F.col("of").alias("other"), "f")
    parts = pair.select("of", "other", "f").unionByName(alone).unionByName(swap(alone)).unionByName(both).unionByName(swap(both))
    value = parts.groupBy("of", "other").agg(F.sum("f").alias("value"))
    pairs = pair.select("of", "other", "lang", "source", "item").join(value, ["of", "other"]).select("lang", "source", "item", "value", F.lit("pair").alias("part"))

    total = broadcast_if(settle(groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms")), "totals"))
    overall = counts.groupBy("id").agg(F.sum("n").alias("n")).join(kept, "id").join(total, "lang")
    overall = overall.select("id", F.col("term").cast("string").alias("item"), _share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    terms = (shares.join(overall, "id").where("p > q").join(small.select("of", "lang", "source"), "of")
             .select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part")))

    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(falling))
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    return ranked.select(*columns).unionByName(best.select(*columns))
