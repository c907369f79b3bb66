"""Documents to packed training sequences: five stages, each an operator of fieldmark.llm.

Each stage gets what its predecessor kept, as Parquet; all but the last return the
columns of documents. NULL and empty texts pass through the stages as their operators
say; other columns are carried along; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import mixing, ngram_join, packing, private_data, quality
from fieldmark.llm.base import broadcast_if, free_name, limit_batches, named, settle, table

# Bytes of an Arrow batch: stages of Python and of shuffles share executors that stay for the whole
# pipeline, so what the pipes hold on both sides comes on top of a heap that is in use.
BATCH_BYTES = 2_000_000


def _lengths(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage has changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the pairwise ranker accepts."""
    limit_batches(spark, BATCH_BYTES)
    ranker = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score, accepted = (free_name(docs.columns, c) for c in ("score", "accepted"))
    scored = quality.score_quality(docs, ranker, keep=docs.columns, output=(score, accepted))
    return scored.where(named(accepted) == 1).select(*map(named, docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (least doc_id); documents without words all stay.

    Documents are told apart by doc_id and text, so different texts of one doc_id are each judged alone.
    """
    limit_batches(spark, BATCH_BYTES)
    groups = settle(ngram_join.similar_groups(docs).where("set_id is not null"), "groups")
    own, digest, one, other = (free_name(docs.columns, c) for c in ("own", "digest", "one", "other"))
    rows = docs.withColumns({own: F.col("doc_id").cast("long"), digest: ngram_join.text_key("text")})

    def joined(kept: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = which.select(F.col("doc_id").alias(one), F.col("key").alias(other))
        return kept.join(broadcast_if(which), kept[own].eqNullSafe(which[one]) & (kept[digest] == which[other]), how)

    dropped = settle(groups.where("not is_first").select("doc_id", "key").distinct(), "dropped")
    kept = joined(rows, dropped, "left_anti")
    # Rows that share id and text are copies too: one of them stays.
    again = settle(groups.where("is_first").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "again")
    if not again.isEmpty():
        once = joined(kept, again, "left_semi").dropDuplicates([own, digest])
        kept = joined(kept, again, "left_anti").unionByName(once)
    return kept.select(*map(named, docs.columns))


def remove_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by the name of its kind."""
    limit_batches(spark, BATCH_BYTES)
    spans, redacted = (free_name(docs.columns, c) for c in ("spans", "redacted"))
    found = private_data.find_private(docs, keep=docs.columns, redacted=True, output=(spans, redacted))
    return _lengths(found.withColumn("text", named(redacted)).select(*map(named, docs.columns)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a last, partial copy holds that many words."""
    return _lengths(mixing.mixed_rows(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    limit_batches(spark, BATCH_BYTES)
    return packing.pack_documents(docs)


STAGES = [("quality", classify_quality), ("near_duplicates", one_of_each_group), ("private_data", remove_private_data),
          ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
