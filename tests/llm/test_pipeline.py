"""The pipeline on rows with every odd case, and its stages one by one."""

import pytest

import corpus_pipeline
from fieldmark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert kept.columns == docs.columns and kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * labels.where("quality = 1").join(docs, "doc_id").count()
    mail = spark.createDataFrame([(10**6, "mail me: a.b@c.de", "en", "s", 16), (None, "no id one two three four", "en", None, 1),
                                  (None, "no id one two three four", "en", "s", 1), (5 * 10**6, None, "en", "s", 0),
                                  (10**6, "mail me: a.b@c.de", "en", "s", 16)], docs.schema)
    once = stages["near_duplicates"](spark, kept.unionByName(mail), SF).cache()
    assert once.where("doc_id = 1000000").count() == once.where("text like 'no id %'").count() == once.where("text is null").count() == 1
    assert stages["near_duplicates"](spark, once, SF).count() == once.count()
    clean = stages["private_data"](spark, once, SF).cache()
    assert clean.where("doc_id = 1000000").first()["text"] == "mail me: [EMAIL]" and clean.count() == once.count()
    mixed = stages["mixing"](spark, clean, SF).cache()
    assert mixed.columns == docs.columns and mixed.where("text is null").count() == 0
    assert stages["packing"](spark, mixed, SF).where("length > 2048").count() == 0


def test_no_text_is_lost_and_names_may_clash(spark):
    """Different texts of one id are each judged alone; columns may be named like inner ones or hold dots."""
    names = "doc_id long, text string, lang string, source string, n_chars long, __key string, __size int, own int, digest int, one int, score int, `a.b` int"
    rows = [(1, "one two three four five six"), (1, "quite different words stand here now ok"), (2, "one two three four five six"),
            (None, "one two three four five six"), (1, "one two three four five six"), (None, "alone but without an id here"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "K", 7, 1, 2, 3, 4, 5) for i, t in rows], names)
    stages = dict(corpus_pipeline.STAGES)
    once = stages["near_duplicates"](spark, docs, SF)
    assert once.columns == docs.columns and once.select("__key", "__size", "`a.b`").distinct().collect() == [("K", 7, 5)]
    assert sorted(((r["doc_id"], r["text"]) for r in once.collect()), key=str) == sorted(
        [(1, rows[0][1]), (1, rows[1][1]), (None, rows[5][1]), (3, None)], key=str)
    for name in ("private_data", "mixing", "quality"):
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() == 0 or out.select("__key", "__size", "score", "`a.b`").distinct().collect() == [("K", 7, 4, 5)]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    from check import compare, connect

    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_workers_keep_nothing_of_earlier_stages(spark):
    import pyarrow as pa

    from fieldmark.llm.base import _worker_store, in_arrow, worker_state

    def using(name):
        def run(batches):
            for _ in batches:
                worker_state(name, lambda: bytearray(1000))
                yield pa.RecordBatch.from_pydict({"held": [",".join(sorted(x for x in vars(_worker_store()) if x in ("one", "two")))]})
        return [r["held"] for r in in_arrow(spark.range(8).coalesce(1), run, "held string").collect()]

    assert using("one") == ["one"] and using("two") == ["two"]


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "private_data", "packing"])
def test_batches_of_the_pipeline_are_bounded(spark, stage):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
        assert int(spark.conf.get(name).rstrip("b")) <= 2_000_000
    finally:
        spark.conf.unset(name)
