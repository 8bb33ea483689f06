"""Folders listed and files read by tasks.

Spark's file readers hold every file of a root in the driver: its name, its size, and the task that reads it.
Here the driver knows the root alone. A task lists folders and tells what lies in them, in three steps: the root,
each folder in it, and everything below a folder in one of those. What a task reads of the files is told by a kept
table, dealt out by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sessionlake.session import kept_folder
from sessionlake.sources.tail import Part, Stretch, filesystem, lines_of

ENTRY = "file STRING, length BIGINT, modified BIGINT, folder BOOLEAN"
TYPES = pa.schema([("file", pa.string()), ("length", pa.int64()), ("modified", pa.int64()), ("folder", pa.bool_())])
LINE = "file STRING, block BIGINT, seq BIGINT, `end` BIGINT, raw STRING"
LINE_NAMES = ["file", "block", "seq", "end", "raw"]
#: Rows in a batch, bytes in a batch, files that one task opens.
ROWS, BYTES, OPENED = 10_000, 1 << 20, 10_000


def plain(root: str) -> str:
    """A root as its files' names begin: a file URL without its scheme, no slash at the end."""
    return re.sub(r"^file:/+", "/", root).rstrip("/")


class Place:
    """A root's file system, and what a file's name is there."""

    def __init__(self, root: str) -> None:
        self.root = plain(root)
        self.files, top = filesystem(self.root or "/")
        self.top = top.rstrip("/")

    def path(self, name: str) -> str:
        return self.top + name[len(self.root) :]

    def name(self, path: str) -> str:
        return self.root + path[len(self.top) :]


def hidden(name: str, folder: bool) -> bool:
    """What Spark's file readers pass over."""
    if folder and name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(place: Place, path: str, missing: bool = True) -> Iterator[tuple[str, int, int, bool]]:
    """What lies in a folder: its files that hold something, and its folders. A folder that has gone meanwhile
    holds nothing."""
    from pyarrow import fs

    for i in place.files.get_file_info(fs.FileSelector(path, allow_not_found=missing)):
        folder = i.type == fs.FileType.Directory
        if not hidden(i.base_name, folder) and (folder or (i.is_file and i.size > 0)):
            yield place.name(i.path), i.size or 0, (i.mtime_ns or 0) // 1_000_000, folder


def _below(place: Place, path: str) -> Iterator[tuple[str, int, int, bool]]:
    due = [path]
    while due:
        for entry in _entries(place, due.pop()):
            if entry[3]:
                due.append(place.path(entry[0]))
            else:
                yield entry


def _batches(rows: Iterator[tuple[str, int, int, bool]]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), TYPES, strict=True)], schema=TYPES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), TYPES, strict=True)], schema=TYPES)


class RootReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        place = Place(self.root)
        yield from _batches(_entries(place, place.top or "/", missing=False))


class RootSource(DataSource):
    """`spark.read.format("session_root").load(root)`: what lies in a root itself."""

    @classmethod
    def name(cls) -> str:
        return "session_root"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> RootReader:
        return RootReader(self.options["path"])


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(file, length, modified): every file under a root that holds something, its time in milliseconds."""

    def opened(everything: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = Place(root)
            for batch in batches:
                folder = batch.column("folder")
                yield batch.filter(pc.invert(folder))
                for name in batch.column("file").filter(folder).to_pylist():
                    yield from _batches((_below if everything else _entries)(place, place.path(name)))

        return run

    spark.dataSource.register(RootSource)
    tasks, found = spark.sparkContext.defaultParallelism, spark.read.format("session_root").load(root)
    for everything in (False, True):
        found = found.repartition(tasks, "file").mapInArrow(opened(everything), ENTRY)
    return found.drop("folder")


def split_bytes(spark: SparkSession) -> int:
    """Bytes of a file that one task reads."""
    told = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(told)


def dealt(files: DataFrame, size: str, *by: str) -> DataFrame:
    """Files, or pieces of some, dealt out to tasks: on average one has `OPENED` of them or the bytes of a split
    at most. `size`: the bytes of each."""
    spark = files.sparkSession
    many = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.expr(size)), F.lit(0)).alias("bytes")).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-many.bytes // split_bytes(spark)), -(-many.n // OPENED))
    return files.repartition(int(tasks), *by)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, so that many small files do not make as many batches."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def contents(root: str, files: DataFrame) -> DataFrame:
    """The columns of `files` and what stands in each, as `content`; a file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Place(root)

        def read() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, name in enumerate(batch.column("file").to_pylist()):
                    with place.files.open_input_file(place.path(name)) as source:
                        held = pa.array([source.read()], pa.binary())
                    row = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*row.columns, held], names=[*row.schema.names, "content"])

        return gathered(read())

    shape = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    return dealt(files, "length", "file").mapInArrow(run, shape)


@dataclass
class Pieces(InputPartition):
    """A part of the table that tells what to read."""

    part: str


class PieceReader(DataSourceReader):
    def __init__(self, root: str, told: str, carry: list[str]) -> None:
        self.root, self.told, self.carry = root, told, carry

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, top = filesystem(plain(self.told))
        found = [i.path for i in files.get_file_info(fs.FileSelector(top)) if i.base_name.startswith("part-")]
        return [Pieces(path) for path in sorted(found)] or [Pieces("")]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        if partition.part:
            yield from gathered(self._lines(partition.part))

    def _lines(self, part: str) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        place = Place(self.root)
        with filesystem(plain(self.told))[0].open_input_file(part) as source:
            for batch in pq.ParquetFile(source).iter_batches(ROWS):
                carried = [batch.column(c) for c in self.carry]
                for k, row in enumerate(batch.select(["file", "length", "low", "high"]).to_pylist()):
                    piece = Part(Stretch(row["file"], 0, row["length"]), row["low"], row["high"])
                    for lines in lines_of(piece, place.files, place.path(row["file"]), tail=True):
                        columns = [lines.column(c) for c in LINE_NAMES] + [pa.repeat(c[k], len(lines)) for c in carried]
                        yield pa.RecordBatch.from_arrays(columns, [*LINE_NAMES, *self.carry])


class PieceSource(DataSource):
    """`spark.read.format("session_pieces").schema(shape).option("pieces", folder).load(root)`: the lines of the
    pieces (file, length, low, high) of a kept table, with others of its columns where the shape has them."""

    @classmethod
    def name(cls) -> str:
        return "session_pieces"

    def reader(self, schema: T.StructType) -> PieceReader:
        return PieceReader(self.options["path"], self.options["pieces"], schema.names[len(LINE_NAMES) :])


def file_lines(spark: SparkSession, root: str, files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(file, block, seq, end, raw) and the columns `carry` of `files`: every line with its count in its piece of
    the file, a last one without a line feed too. Pieces are cut where lines begin."""
    step, lows = split_bytes(spark), F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes(spark)))
    cut = files.filter("length > 0").select("file", "length", *carry, F.explode(lows).alias("low")).withColumn(
        "high", F.least(F.col("low") + step, F.col("length"))
    )
    folder = kept_folder(spark, "pieces")
    dealt(cut, "high - low", "file", "low").write.parquet(folder)
    shape = T.StructType([*T.StructType.fromDDL(LINE).fields, *(files.schema[c] for c in carry)])
    spark.dataSource.register(PieceSource)
    return spark.read.format("session_pieces").schema(shape).option("pieces", folder).load(root)
