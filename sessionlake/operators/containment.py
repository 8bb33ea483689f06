"""Which line of a thread holds given words last, without searching every line for every words.

Of words, the last eight bytes stand for them (all of them, where they are fewer): a number of 64 bits.
Lines give the numbers at all their places, but only those that a bitmap of fixed size lets through, in
which the words' numbers are marked; what is left meets the words of its thread on equality, and lines
that meet longer words are asked whether they hold them. Where words are so many that the bitmap is full, more
places pass and the join does all the work: no answer depends on it. No thread is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.operators.windows import THREAD

#: Bytes that stand for words, and the bitmap's places (half a megabyte of bits).
GRAM, PLACE_BITS = 8, 22
PLACES = 1 << PLACE_BITS
#: Bytes of lines looked through at a time, where no single line is longer.
AT_ONCE = 1 << 20

_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _spread(gram: np.ndarray) -> np.ndarray:
    """The place of grams in the bitmap of their size."""
    h = gram * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def _gram(words: Column) -> Column:
    """The last eight bytes as hexadecimal digits, in the order they stand."""
    return F.right(F.hex(F.encode(words, "utf-8")), F.lit(2 * GRAM))


def _number(digits: str) -> int:
    return int.from_bytes(bytes.fromhex(digits), "little")


def grams_in(raw: pa.Array, marks: dict[int, np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """The row and gram of all places the bitmaps let through, each once a row. `marks`: by size."""
    values = raw.cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    padded = np.concatenate([held, np.zeros(GRAM, np.uint8)])
    eights = np.ndarray(len(held), "<u8", padded, strides=(1,)) if len(held) else np.zeros(0, np.uint64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    rows, grams = [], []
    for size, bits in marks.items():
        some = eights & _LOW[size]
        at = np.flatnonzero(bits[_spread(some)] & (np.arange(len(held)) + size <= ends))
        row = np.searchsorted(offsets, at, side="right") - 1
        pairs = np.unique(np.stack([row.astype(np.uint64), some[at]]), axis=1)
        rows.append(pairs[0].astype(np.int64))
        grams += [int(g).to_bytes(8, "little")[:size].hex().upper() for g in pairs[1]]
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), grams


def last_lines_with(lines: DataFrame, words: DataFrame) -> DataFrame:
    """session_id, source, words, line_no for all `words` (session_id, source, words) that some line of
    their thread holds. Empty words are in every line; null ones, and threads that are null, in none."""
    spark = lines.sparkSession
    asked = words.filter(F.col("words").isNotNull()).withColumn("gram", _gram(F.col("words")))
    marked = _marks(asked.filter("gram <> ''"))
    shared = spark.sparkContext.broadcast({size: np.packbits(bits) for size, bits in marked.items()})
    fields = {f.name: f for f in lines.schema.fields}
    schema = T.StructType([*[fields[c] for c in (*THREAD, "line_no")], T.StructField("gram", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = {size: np.unpackbits(bits).astype(bool) for size, bits in shared.value.items()}
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("raw")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            low = 0
            while low < batch.num_rows:
                base = sizes[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(sizes, base + AT_ONCE, side="right")))
                some = batch.slice(low, high - low)
                rows, grams = grams_in(some.column("raw").fill_null(""), marks)
                kept = [some.column(c).take(pa.array(rows)) for c in (*THREAD, "line_no")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(grams, pa.string())], schema.names)
                low = high

    threads = asked.filter("gram <> ''").select(*THREAD).distinct()
    places = lines.join(threads, THREAD, "left_semi").select(*THREAD, "line_no", "raw").mapInArrow(run, schema)
    met = places.join(asked.select(*THREAD, "gram", "words"), [*THREAD, "gram"]).select(*THREAD, "line_no", "words")
    whole = F.octet_length("words") <= GRAM
    longer = (
        met.filter(~whole).join(lines.select(*THREAD, "line_no", "raw"), [*THREAD, "line_no"])
        .filter(F.contains(F.col("raw"), F.col("words"))).select(*THREAD, "line_no", "words")
    )
    empty = asked.filter("gram = ''").select(*THREAD, "words").join(
        lines.filter(F.col("raw").isNotNull()).select(*THREAD, "line_no"), THREAD
    ).select(*THREAD, "line_no", "words")
    every = met.filter(whole).unionByName(longer).unionByName(empty)
    return every.groupBy(*THREAD, "words").agg(F.max("line_no").alias("line_no"))


def _marks(asked: DataFrame) -> dict[int, np.ndarray]:
    """The bitmaps, one for each size of grams: their places are counted on the executors, and no more of
    them than there are reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = batch.column("gram").to_pylist()
            size = np.array([len(d) // 2 for d in digits], np.int64)
            grams = np.array([_number(d) for d in digits], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(_spread(grams))], ["size", "place"])

    found = asked.select("gram").distinct().mapInArrow(run, "size long, place long").distinct().toArrow()
    marks: dict[int, np.ndarray] = {}
    for size in set(found.column("size").to_pylist()):
        bits = np.zeros(PLACES, bool)
        bits[found.filter(pc.equal(found.column("size"), size)).column("place").to_numpy()] = True
        marks[size] = bits
    return marks
