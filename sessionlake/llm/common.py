"""What the operators share: safe column names, text fingerprints, small slices of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Rows that go to Python at once, and their bytes where Spark counts them. Texts are long; Spark's own
#: bounds would hold several copies of 64 MiB a task.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """`docs`, after its session has been told to hand texts to Python in small batches."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def release() -> None:
    """Gives memory that a finished task has freed back to the machine, as workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of `df` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`{}`".format(name.replace("`", "``")))


def fingerprint(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Just `doc_id` and `text`, null text as empty, whatever other columns there are."""
    return small_batches(docs).select(
        F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows of at most `most` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            base = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(low, high - low)
            low = high
    release()


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0
