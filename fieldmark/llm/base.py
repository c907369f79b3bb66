"""What the operators of this package share: column selection, words, Python worker state."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import fieldmark
from fieldmark.session import settle  # noqa: F401

# Python workers get the package's functions by value: they need no copy of it.
cloudpickle.register_pickle_by_value(fieldmark)

# Fixed by the contracts: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Bytes of text that a Python worker holds at once, whatever the length of single rows.
CHUNK_BYTES = 8_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, which may hold dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores behind as long as a column has it (upper and lower case alike)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def broadcast_if(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Mark a narrow frame for broadcast if it is counted to be small; beyond that a shuffle join is used.

    The frame is read twice: pass settled results.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def worker_state(name: str, make):
    """An object that is made once for each Python worker and lives until the worker serves another stage."""
    store = _worker_store()
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def _worker_store() -> types.ModuleType:
    return sys.modules.setdefault("_fieldmark_worker", types.ModuleType("_fieldmark_worker"))


def enter_stage(stage: int) -> None:
    """Drop what earlier stages left in this worker: Spark keeps workers, and so all their memory, for the whole session."""
    kept = vars(_worker_store())
    if kept.get("__stage__") != stage:
        for name in [x for x in kept if not x.startswith("__")]:
            del kept[name]
        kept["__stage__"] = stage
        pa.default_memory_pool().release_unused()


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow with batches of at most CHUNK_BYTES, as texts may be long.

    Sets the session's limit, if it is higher: both sides of the pipe hold whole batches.
    """
    def of_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_stage(TaskContext.get().stageId())
        yield from run(batches)

    limit_batches(df.sparkSession, CHUNK_BYTES)
    return df.mapInArrow(of_stage, schema)


def limit_batches(spark: SparkSession, most: int) -> None:
    """Let the session's Arrow batches hold at most so many bytes; a lower limit stays."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(conf.get(name)).rstrip("b") or 0) <= most:
        conf.set(name, f"{most}b")


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece stay below CHUNK_BYTES (or are a single row)."""
    for batch in batches:
        if batch.num_rows:
            texts = batch.column(batch.schema.names.index(column))
            sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            start = held = 0
            for i, size in enumerate(sizes.tolist()):
                if i > start and held + size > CHUNK_BYTES:
                    yield batch.slice(start, i - start)
                    start, held = i, 0
                held += size
            yield batch.slice(start)
