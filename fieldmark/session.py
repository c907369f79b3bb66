"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest number of rows of one key that is left to a single task. Keys beyond
# it are split (see operators.hotkeys and operators.ordered).
ROWS_PER_TASK_CONF = "fieldmark.rowsPerTask"
ROWS_PER_TASK_DEFAULT = 2_000_000


def build_session(app: str = "fieldmark", cpus: int | str = "*", **conf) -> SparkSession:
    """A local session with the settings the library expects."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK_CONF, str(ROWS_PER_TASK_DEFAULT)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where the session names none (local tests) is one chosen here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = "/tmp/fieldmark-scratch"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never used path below the shared folder."""
    return f"{shared_dir(spark)}/fieldmark/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For results that are used several times: they are computed once, their
    lineage ends here, and a lost executor loses none of them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.settled_path = path
    return kept


def settle_lean(df: DataFrame, label: str = "step") -> DataFrame:
    """Like settle, and the shuffle files of the job go with it, not only when the driver next collects garbage.

    Sets the session's option while the job runs, so not for jobs side by side with others that read a frame twice.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return settle(df, label)
    finally:
        conf.set(name, before)


def discard(*steps: DataFrame) -> None:
    """Delete the files of settled steps; only where everything made from them is settled or done with."""
    for step in steps:
        path = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step.settled_path)
        path.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
