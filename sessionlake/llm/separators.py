"""Token counts by a separator scan over flat token files without an index.

A token file is nothing but ids, `width` bytes each, little-endian, with the end id after every
document, cut into blocks of fixed size wherever that falls. Each block is searched for the end id
as one vector. What a block alone cannot know is how many documents and ids came before it and where
the last document before it ended; that is a prefix scan over a row per block: running sums of ids
and ends, and a running maximum of the last end. A document that spans blocks is so put together
from its parts without reading any block twice.

Ids after the last end of a file are a document without an end and count as one. Files are
independent: no document reaches into the next. The files written here hold the documents of one
task each, in the order the task read them; beside them stand the names of the documents in that
order, which say nothing of lengths. Null and empty texts are documents of just the end id. Rows that
repeat are documents each. The strings of special tokens in a text are ordinary text, so a text
cannot end a document. Only `doc_id` and `text` are read. No rows, no files, no counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import id_and_text, slices, task_number
from sessionlake.llm.tokens import encoder, vocabulary
from sessionlake.session import keep, shared_folder

END, BLOCK = 50256, 1 << 18


def write_flat(docs: DataFrame, path: str | None = None, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Writes the files; gives a table of rows (file, block, data) and rows (file, first, names), the
    other columns null. Blocks are compressed as Spark compresses any column."""
    path = path or vocabulary("byte_bpe_50k.json")
    docs = id_and_text(docs)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("file", T.LongType()), T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType()),
            T.StructField("first", T.LongType()), T.StructField("names", T.ArrayType(kind)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, first, held = task_number(), 0, 0, np.zeros(0, f"<u{width}")
        tool, no_long = encoder(path, True, True), pa.nulls(1, pa.int64())
        for batch in slices(batches):
            names = batch.column("doc_id")
            ids, _ = tool.encode(batch.column("text"), end)
            held = np.concatenate([held, ids.astype(f"<u{width}")])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file]), no_long, pa.nulls(1, pa.binary()), pa.array([first]),
                    pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                ],
                schema.names,
            )
            first += len(names)
            whole = len(held) // block * block
            for low in range(0, whole, block):
                yield cell(file, number, held[low : low + block], names.type)
                number += 1
            held = held[whole:]
        if len(held):
            yield cell(file, number, held, kinds[0])

    def cell(file: int, number: int, ids: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([file]), pa.array([number]), pa.array([ids.tobytes()], pa.binary()),
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(kind)),
            ],
            schema.names,
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(kind)]
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/kept/flat-{uuid.uuid4().hex}"
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def scan(files: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(file, number, start, n_tokens) of every document of the files: its place among the file's
    documents, the ids before it in the file, and its ids with the end id."""
    kind = "file long, block long, size long, ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("data")[k].as_buffer(), f"<u{width}")
                ends = np.flatnonzero(ids == end).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("file").slice(k, 1), batch.column("block").slice(k, 1), pa.array([len(ids)]),
                        pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends)),
                    ],
                    ["file", "block", "size", "ends"],
                )

    blocks = files.where(F.col("data").isNotNull()).select("file", "block", "data").mapInArrow(run, kind)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = (
        keep(blocks, "ends")
        .withColumn("base", F.coalesce(F.sum("size").over(before), zero))
        .withColumn("number", F.coalesce(F.sum(F.size("ends")).over(before), zero))
        .withColumn("last", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1) + 1))
        .withColumn("begun", F.coalesce(F.max("last").over(before), zero))
    )
    each = F.transform(
        "ends",
        lambda e, k: F.struct(
            F.when(k == 0, F.col("begun")).otherwise(F.col("base") + F.get("ends", k - 1) + 1).alias("start"),
            (F.col("base") + e + 1).alias("stop"),
        ),
    )
    ended = placed.select("file", "number", F.posexplode(each).alias("k", "doc")).select(
        "file", (F.col("number") + F.col("k")).alias("number"), F.col("doc.start").alias("start"),
        (F.col("doc.stop") - F.col("doc.start")).alias("n_tokens"),
    )
    rest = placed.groupBy("file").agg(
        F.sum(F.size("ends")).alias("number"), F.coalesce(F.max("last"), zero).alias("start"), F.sum("size").alias("size")
    )
    rest = rest.where(F.col("size") > F.col("start"))
    return ended.unionByName(rest.select("file", "number", "start", (F.col("size") - F.col("start")).alias("n_tokens")))


def counts(files: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(doc_id, file, start, n_tokens): the scan's documents with their names."""
    names = files.where(F.col("names").isNotNull()).select("file", "first", F.posexplode("names").alias("k", "doc_id"))
    names = names.select("file", (F.col("first") + F.col("k")).alias("number"), "doc_id")
    return scan(files, end, width).join(names, ["file", "number"]).select("doc_id", "file", "start", "n_tokens")
