"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.base import WORD, broadcast_if, named, settle, word_count
from fieldmark.operators.ordered import row_numbers

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3

# The hash of a document has LEVELS digits of DIGIT bits; each histogram refines one digit.
LEVELS, DIGIT = 4, 12


def document_hash(doc_id: Column) -> Column:
    """48 bits of the md5 of the id's decimal text; a NULL id counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, copies: int = MOST_COPIES) -> DataFrame:
    """Target words of each source: (key, source, source_size) -> + weight, target.

    Sources in code point order, NULL last, take the weights in turn. A source gets at
    most `copies` times its size; what it would get beyond that goes to the others by
    weight. Sources that reach their limit keep it, so each round only adds such sources
    and the loop ends.
    """
    ranked = sizes.withColumn("null_last", F.col("source").isNull())
    ranked = settle(row_numbers(ranked.withColumn("all", F.lit(0)), ["all"], ["null_last", "source"], "rank"), "sources")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int"))
    cap = copies * F.col("source_size")
    ranked = ranked.select("key", "source", "source_size", weight.alias("weight"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # level: words for each unit of weight of the sources below their limit
        done = F.col("weight") * level >= cap if full >= 0 else F.lit(False)
        held, open_weight, n = ranked.agg(F.sum(F.when(done, cap)), F.sum(F.when(~done, F.col("weight"))),
                                          F.count_if(done)).first()
        if n == full or not open_weight:
            break
        full, level = n, (total - (held or 0)) / open_weight
    target = F.least(F.col("weight") * level, cap.cast("double")) if total else F.lit(0.0)
    return ranked.withColumn("target", target)


def _keys(doc_id: Column, source: Column, size: Column) -> list[Column]:
    """__size, __hash and __key of a document. Columns of the table itself never stand beside them."""
    key = F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))
    return [size.alias("__size"), document_hash(doc_id).alias("__hash"), key.alias("__key")]


def _thresholds(own: DataFrame, weights: tuple, copies: int) -> DataFrame:
    """One row for each source: __key, source_size, target, whole, budget, low, edge (see mix)."""
    sizes = own.groupBy("__key", "source").agg(F.sum("__size").alias("source_size")).withColumnRenamed("__key", "key")
    plan = source_targets(sizes, weights, copies).withColumnRenamed("key", "__key")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.floor("target").cast("long") - F.col("whole") * F.col("source_size")
    plan = settle(plan.withColumn("whole", whole).withColumn("budget", budget).withColumn("low", F.lit(0).cast("long"))
                  .select("__key", "source_size", "target", "whole", "budget", "low"), "targets")
    for level in range(LEVELS):
        # Of each source, the documents that share the digits of `low` so far: words by the next digit.
        shift = DIGIT * (LEVELS - 1 - level)
        inside = own
        if level:
            inside = own.join(broadcast_if(plan.where("budget > 0").select("__key", "low")), "__key")
            inside = inside.where(F.shiftright("__hash", shift + DIGIT) == F.shiftright("low", shift + DIGIT))
        bars = inside.groupBy("__key", F.shiftright("__hash", shift).alias("bar")).agg(F.sum("__size").alias("words"))
        run = Window.partitionBy("__key").orderBy("bar")  # at most 2 ** DIGIT rows of a source
        bars = bars.withColumn("upto", F.sum("words").over(run))
        cut = (bars.join(broadcast_if(plan.select("__key", "budget")), "__key").where("upto > budget").groupBy("__key")
               .agg(F.min_by(F.struct("bar", (F.col("upto") - F.col("words")).alias("before")), "bar").alias("cut")))
        plan = settle(plan.join(cut, "__key", "left").select(
            "__key", "source_size", "target", "whole",
            (F.col("budget") - F.coalesce(F.col("cut.before"), F.lit(0))).alias("budget"),
            F.coalesce(F.shiftleft(F.col("cut.bar"), shift), F.col("low")).alias("low")), "threshold")
    edge = (own.join(broadcast_if(plan.select("__key", "low")), "__key").where("__hash = low")
            .groupBy("__key").agg(F.sum("__size").alias("edge")))
    return settle(plan.join(edge, "__key", "left"), "mixplan")


def _share(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan and __rest, the words of the copy that not all documents get."""
    rest = (F.when(F.col("__hash") < F.col("low"), F.col("__size"))
            .when((F.col("__hash") == F.col("low")) & (F.col("edge") > 0),
                  F.expr("(cast(__size as decimal(38,0)) * budget) div edge"))
            .otherwise(F.lit(0)).cast("long"))
    plan = plan.select("__key", *[F.struct("source_size", "target", "whole", "budget", "low", "edge").alias("__plan")])
    joined = rows.join(broadcast_if(plan), "__key")
    # the expressions above read the plan's columns by their plain names
    names = rows.columns
    flat = joined.select(F.struct(*names).alias("__row"), "__key", "__size", "__hash", "__plan.*")
    return flat.select("__row.*", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
                       F.col("whole").alias("__whole"),
                       F.when(F.col("source_size") > 0, rest).otherwise(F.lit(0)).cast("long").alias("__rest"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None,
        text: str = "text", weights: tuple = WEIGHTS, copies: int = MOST_COPIES) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken, whole, rest.

    A source takes each document whole = floor(target / source_size) times, and those
    below a threshold of the document hash once more. Words are summed by source and hash
    digit; the digit in which the budget ends is summed again by the next digit, and so
    on, so thresholds are nested: a larger budget takes a superset. Documents at the
    threshold itself (one, but for equal ids) give floor(size * missing / their size)
    words, `missing` being what the budget still lacks. rest is what a document gives to
    this last copy; taken = whole * size + rest. Nothing is sorted and no document is
    dropped from the result.

    NULL texts have size 0; NULL is a source of its own; sources without words get the
    target 0; repeated rows are documents of their own and share a hash; no documents
    give no rows; other columns are ignored.
    """
    words = size if size is not None else word_count(named(text))
    own = settle(docs.select(named(doc_id).alias("doc_id"), named(source).cast("string").alias("source"),
                             *_keys(named(doc_id), named(source), words)), "mix")
    shared = _share(own, _thresholds(own, weights, copies))
    return shared.select("doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                         F.col("__target").alias("target"), (F.col("__whole") * F.col("__size") + F.col("__rest")).alias("taken"),
                         F.col("__whole").alias("whole"), F.col("__rest").alias("rest"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
               weights: tuple = WEIGHTS, copies: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns.

    A last copy that is not taken whole keeps its first `rest` words, joined by blanks.
    Documents without words are in no mix.
    """
    keys = _keys(named(doc_id), named(source), word_count(named(text)))
    own = settle(docs.select(named(source).cast("string").alias("source"), *keys), "mix")
    # The document travels as one struct, so its columns may have any names.
    whole = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = _share(docs.select(whole.alias("__doc"), *keys), _thresholds(own, weights, copies))
    number = F.col("__whole") + (F.col("__rest") > 0).cast("long")
    rows = rows.where((number > 0) & (F.col("__size") > 0)).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), number)))
    partial = (F.col("__copy") > F.col("__whole")) & (F.col("__rest") < F.col("__size"))

    def column(i: int, name: str) -> Column:
        value = F.col("__doc")[f"c{i}"]
        if name != text:
            return value.alias(name)
        words = F.slice(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)), F.lit(1), F.col("__rest").cast("int"))
        return F.when(partial, F.array_join(words, " ")).otherwise(value).alias(name)

    return rows.select(*[column(i, c) for i, c in enumerate(docs.columns)])
