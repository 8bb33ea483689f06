"""Token ids as directly addressable codes: levels of 8-bit chunks with continuation bitmaps.

A file is a run of segments. In a segment, level 0 holds the low byte of every id and a bitmap that
marks the ids that go on; level 1 holds the next byte of just those, and so on. A rank directory
keeps the count of ones before every 512 bits, so the place of an id's next chunk is one look-up and
a popcount: any id is read without decoding its neighbours.

Segment, little-endian: magic `DAC1`, count u32, levels u32, then per level: entries u32, the chunk
bytes, the bitmap (entries bits, low bit first, padded to 64 bytes) and the directory (u32 per 64
bytes of bitmap). The last level has no bitmap or directory.

Segments are written as rows of a table (one binary cell each), as that is what Spark can write to
and read from any store; beside a segment stand the documents in it, their counts, and its place in
its file. Documents go in ascending id, null first; equal ids by their row in the input. Null and
empty texts have only the end id. Repeated rows are encoded each for itself. Only `doc_id` and
`text` are read. An empty table gives empty files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import id_and_text, slices, task_number
from sessionlake.llm.tokens import encoder, vocabulary
from sessionlake.session import keep

MAGIC, STRIDE = b"DAC1", 64
#: Ids in a segment, unless one document has more.
SEGMENT = 1 << 19


def to_codes(ids: np.ndarray) -> bytes:
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        last = not more.any()
        body = [struct.pack("<I", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes()]
        if not last:
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % STRIDE, np.uint8)])
            ones = np.bitwise_count(bits).reshape(-1, STRIDE).sum(1, dtype=np.uint32)
            body += [bits.tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).tobytes()]
        levels.append(b"".join(body))
        if last:
            return b"".join([MAGIC, struct.pack("<II", len(ids), len(levels)), *levels])
        rest = rest[more] >> np.uint32(8)


class Codes:
    """Reads a segment."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a segment of addressable codes")
        self.count, depth = struct.unpack_from("<II", data, 4)
        self.levels, at = [], 12
        for level in range(depth):
            (n,) = struct.unpack_from("<I", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            at += 4 + n
            bits = ranks = None
            if level + 1 < depth:
                size = -(-n // (8 * STRIDE)) * STRIDE
                bits = np.frombuffer(data, np.uint8, size, at)
                ranks = np.frombuffer(data, "<u4", size // STRIDE, at + size)
                at += size + 4 * (size // STRIDE)
            self.levels.append((chunks, bits, ranks))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // (8 * STRIDE)
            before = int(np.bitwise_count(bits[block * STRIDE : i >> 3]).sum())
            before += (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            i, shift = int(ranks[block]) + before, shift + 8
        return value

    def all(self) -> np.ndarray:
        deeper = None
        for chunks, bits, _ in reversed(self.levels):
            values = chunks.astype(np.uint32)
            if bits is not None:
                more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                values[more] |= deeper << np.uint32(8)
            deeper = values
        return deeper



def write_codes(docs: DataFrame, path: str | None = None, end: int = 2) -> DataFrame:
    """Writes the files and gives their table: one row per segment, `inside` its file `part` after
    that many ids. Where a part starts is not in it: that follows from the parts before."""
    path = path or vocabulary("byte_bpe_50k.json")
    docs = id_and_text(docs)
    kind = docs.schema["doc_id"].dataType
    row = F.monotonically_increasing_id().alias("row")
    ordered = docs.select("doc_id", "text", row)
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("row"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("row"))
    schema = T.StructType(
        [
            T.StructField("part", T.LongType()),
            T.StructField("inside", T.LongType()),
            T.StructField("tokens", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("data", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, inside, tool = task_number(), 0, encoder(path, True)
        ids, counts, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = to_codes(np.concatenate(ids))
            every = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part]), pa.array([inside]), pa.array([held]),
                    pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every),
                    pa.array([np.concatenate(counts).tolist()], pa.list_(pa.int64())),
                    pa.array([data], pa.binary()),
                ],
                schema.names,
            )

        for batch in slices(batches):
            new, lengths = tool.encode(batch.column("text"), end)
            ids.append(new), counts.append(lengths), names.append(batch.column("doc_id"))
            held += len(new)
            if held >= SEGMENT:
                yield flush()
                inside += held
                ids, counts, names, held = [], [], [], 0
        if held:
            yield flush()

    return keep(ordered.select("doc_id", "text").mapInArrow(run, schema), "codes")


def read_codes(files: DataFrame) -> DataFrame:
    """Per document, from the files: the ids of all documents before it, its count, its checksum.

    Where a part begins is summed over the parts, of which there are as many as tasks that wrote."""
    spark, kind = files.sparkSession, files.schema["doc_ids"].dataType.elementType
    sums = files.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    begun, total = [], 0
    for part, n in sums:
        begun.append((part, total))
        total += n
    parts = spark.createDataFrame(begun, "part long, begun long")
    schema = T.StructType(
        [
            T.StructField("doc_id", kind), T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = Codes(batch.column("data")[k].as_py()).all().astype("<u4")
                counts = np.array(batch.column("counts")[k].as_py(), np.int64)
                ends = np.cumsum(counts)
                crcs = [
                    zlib.crc32(ids[a:b].tobytes())
                    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[k].values,
                        pa.array(batch.column("start")[k].as_py() + ends - counts),
                        pa.array(counts), pa.array(crcs, pa.int64()),
                    ],
                    schema.names,
                )

    start = (F.col("begun") + F.col("inside")).alias("start")
    placed = files.join(F.broadcast(parts), "part")
    return placed.select("doc_ids", "counts", "data", start).mapInArrow(run, schema)
