import time

import numpy as np

from fieldmark.llm import ngram_join


def test_shuffles_of_near_duplicate_steps_leave_the_disk(spark):
    """Most steps shuffle; what a finished one wrote is gone, whether or not the driver collected garbage."""
    def files():
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",")
        return {f for f in kept if f.endswith(".data")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{w}" for w in rng.integers(0, 500, 60)) for _ in range(20)]
    rows = [(i, f"{base[i % 20]} x{i % 40}") for i in range(120)]
    before, option = files(), spark.conf.get(name, "false")
    found = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    for _ in range(50):                         # executors delete on their own
        left = [f for f in files() - before if "shuffle" in f]
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(name, "false") == option
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(i, i % 20) for i in range(120)}
