"""Importance resampling towards a target, with checksums of n-grams by a position table.

Features are all runs of 1 to `longest` consecutive words (A-Z lower-cased, joined by one blank), hashed
to buckets by their CRC-32. A checksum is a constant of the length xor one term for each byte, which
depends only on the byte and its distance from the end; terms of `REACH` distances stand in one table.
All features of a slice of texts are laid out as spans, their terms looked up at once and folded by
`bitwise_xor.reduceat`. A longer span is folded in blocks of `REACH` bytes from its end, and blocks pair
by pair: the checksum of what stands in front is moved over the bytes behind by a linear map.

`bucket_counts` adds up features per bucket: each task counts into one array, and tasks' arrays are added
by bucket, so what is shuffled is set by the buckets. `gains` compares target and raw counts, bucket by
bucket. `weighed` gives a document the floored mean of the gains of its features. `drawn` adds Gumbel noise
from a digest of seed and id and ranks the highest; ranks are counted over ranges, no task sorts them all.

Null and empty texts have no features, weight 0, and are never drawn. Repeated rows are documents of their
own with equal scores; a null id counts as an empty one. Equal scores go by smaller id (null last), then by the row's own figures, and rows
equal in all take neighbouring ranks in any order. Words may be of any length, texts too: features are
laid out `SPREAD` bytes at a time. With no documents there are no rows; with an empty target every
bucket's gain follows from the formula alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import id_and_text, slices, task_number
from sessionlake.llm.words import raw_bytes
from sessionlake.session import keep

BUCKETS, LONGEST, SEED = 10_000, 2, 7
MIN_WORDS, PERCENT = 20, 25
#: Distances from the end that the table holds: 2^6.
LOG_REACH = 6
REACH = 1 << LOG_REACH
#: Bytes of features laid out at a time, where no single one is longer.
SPREAD = 1 << 20

#: The reversed polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What a word is made of: digits, letters, and all beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@cache
def byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(POLYNOMIAL), value >> 1)
    return value


@cache
def position_table() -> np.ndarray:
    """The term of each byte at each distance from the end, row by row: moved on by one zero byte a row."""
    table, one = np.empty((REACH, 256), np.uint32), byte_table()
    table[0] = one
    for d in range(1, REACH):
        table[d] = (table[d - 1] >> np.uint32(8)) ^ one[table[d - 1] & 0xFF]
    return table.ravel()


@cache
def moved_over(power: int) -> np.ndarray:
    """The linear map of a register over 2^power zero bytes, as four tables of 256."""
    if power == 0:
        bits = np.array([1 << k for k in range(32)], np.uint32)
        moved = (bits >> np.uint32(8)) ^ byte_table()[bits & 0xFF]
    else:
        half = moved_over(power - 1)
        moved = _apply(half, _apply(half, np.array([1 << k for k in range(32)], np.uint32)))
    table = np.zeros((4, 256), np.uint32)
    for part in range(4):
        for bit in range(8):
            with_bit = np.arange(256) >> bit & 1 == 1
            table[part][with_bit] ^= moved[8 * part + bit]
    return table


def _apply(table: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (
        table[0][value & 0xFF] ^ table[1][value >> np.uint32(8) & 0xFF]
        ^ table[2][value >> np.uint32(16) & 0xFF] ^ table[3][value >> np.uint32(24)]
    )


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """The checksum of that many zero bytes less its terms: the first register, moved over all of them,
    and the last inversion."""
    value = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    power = 0
    rest = lengths.astype(np.int64)
    while rest.any():
        odd = rest & 1 == 1
        value[odd] = _apply(moved_over(power), value[odd])
        rest, power = rest >> 1, power + 1
    return value ^ np.uint32(0xFFFFFFFF)


def _folded(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The terms of each span of at most `REACH` bytes, xored."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
    distance = np.repeat(sizes - 1, sizes) - at
    terms = position_table()[(distance << 8) | raw[np.repeat(begins, sizes) + at]]
    return np.bitwise_xor.reduceat(terms, ends - sizes)


def checksums(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of `raw`, none of them empty."""
    out = np.empty(len(begins), np.uint32)
    blocks = -(-sizes // REACH)
    short = np.flatnonzero(blocks == 1)
    bounds = np.searchsorted(np.cumsum(sizes[short]), np.arange(SPREAD, int(sizes[short].sum()) + SPREAD, SPREAD), side="right")
    low = 0
    for high in [*bounds.tolist(), len(short)]:
        if high > low:
            some = short[low:high]
            out[some] = _folded(raw, begins[some], sizes[some])
            low = high
    for k in np.flatnonzero(blocks > 1).tolist():
        out[k] = _long(raw[begins[k] : begins[k] + sizes[k]])
    shortest = np.bincount(sizes[short]) if short.size else np.zeros(1, np.int64)
    constants = np.zeros(len(shortest), np.uint32)
    known = np.flatnonzero(shortest)
    constants[known] = length_constants(known)
    out[short] ^= constants[sizes[short]]
    longer = np.flatnonzero(blocks > 1)
    out[longer] ^= length_constants(sizes[longer])
    return out


def _long(span: np.ndarray) -> np.uint32:
    """The terms of a long span: blocks counted from its end, then pairs of neighbours, level by level."""
    parts = []
    per = SPREAD // REACH
    first = len(span) % REACH or REACH
    cuts = np.concatenate([[0], np.arange(first, len(span), REACH)])
    sizes = np.diff(np.append(cuts, len(span)))
    for low in range(0, len(cuts), per):
        parts.append(_folded(span, cuts[low : low + per], sizes[low : low + per]))
    values, power = np.concatenate(parts), LOG_REACH
    while len(values) > 1:
        if len(values) & 1:
            values = np.concatenate([np.zeros(1, np.uint32), values])
        values = _apply(moved_over(power), values[0::2]) ^ values[1::2]
        power += 1
    return values[0]


def joined_words(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in a row, lower-cased, one blank behind each; where each begins and
    ends there; and how many words each text has. No nulls."""
    raw, offsets = raw_bytes(values)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return raw, none, none, np.zeros(len(values), np.int64)
    inside = IN_WORD[raw]
    begins_here, ends_here = inside.copy(), inside.copy()
    begins_here[1:] &= ~inside[:-1]
    ends_here[:-1] &= ~inside[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins_here[firsts] |= inside[firsts]
    lasts = firsts[1:] - 1
    ends_here[lasts] |= inside[lasts]
    starts, stops = np.flatnonzero(begins_here), np.flatnonzero(ends_here) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    # Word k moves to behind the words before it and a blank for each of them.
    begins = np.cumsum(stops - starts + 1) - (stops - starts + 1)
    text = np.full(int((stops - starts + 1).sum()), 0x20, np.uint8)
    text[np.arange(int(inside.sum())) + np.repeat(np.arange(len(starts)), stops - starts)] = LOWER[raw[inside]]
    return text, begins, begins + (stops - starts), counts


def features(values: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, text by text, how many each text has, and its words."""
    text, begins, ends, words = joined_words(values)
    last = np.repeat(np.cumsum(words), words)
    found, number = [], []
    owner = np.repeat(np.arange(len(words)), words)
    for n in range(1, longest + 1):
        at = np.flatnonzero(np.arange(len(begins)) + n <= last)
        found.append(checksums(text, begins[at], ends[at + n - 1] - begins[at]) % np.uint32(buckets))
        number.append(owner[at])
    owner, bucket = np.concatenate(number), np.concatenate(found).astype(np.int64)
    return bucket[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words)), words


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all of `docs`."""
    only = id_and_text(docs.select(F.lit(None).cast("int").alias("doc_id"), "text")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(features(batch.column("text"), longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counts = only.mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: 1000 times the log of how much likelier the target holds it, floored.
    One number a bucket reaches the driver."""
    both = bucket_counts(docs, longest, buckets).withColumn("of", F.lit(0)).unionByName(
        bucket_counts(target, longest, buckets).withColumn("of", F.lit(1))
    )
    counted = np.zeros((2, buckets), np.int64)
    for row in both.collect():
        counted[row["of"], row["bucket"]] = row["n"]
    raw, wanted = counted.astype(np.float64)
    ratio = (wanted + 1) * (raw.sum() + buckets) / ((raw + 1) * (wanted.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight, and `row`, a number of its own."""
    docs = id_and_text(docs)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(name, T.LongType()) for name in ("n_words", "n_features", "weight", "row")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = task_number() << 40
        for batch in slices(batches):
            bucket, counts, words = features(batch.column("text"), longest, len(gain))
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])
            ends = np.cumsum(counts)
            weight = (sums[ends] - sums[ends - counts]) // np.maximum(counts, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (words, counts, weight, np.arange(row, row + len(words))))],
                schema.names,
            )
            row += len(words)

    return docs.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def drawn(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
    longest: int = LONGEST, buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: 1, 2, 3... for the drawn, else null.

    Rows in order of score stand in ranges, each a written part; a row's rank is its place in its range
    behind the sizes of the ranges before, of which there are as many as shuffle partitions."""
    weights = weighed(docs, gains(docs, target, longest, buckets), longest)
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    scored = weights.withColumn("score", F.col("weight") + noise(named, seed))
    fit = F.col("n_words") >= min_words
    order = [
        F.when(fit, F.col("score")).desc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(),
        F.col("weight").asc(), F.col("row").asc(),
    ]
    kept = keep(scored, "scored")
    ranged = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*kept.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("inside", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, inside = task_number(), 0
        for batch in batches:
            places = np.arange(inside + 1, inside + 1 + batch.num_rows)
            inside += batch.num_rows
            numbers = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(places)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], schema.names)

    placed = keep(ranged.mapInArrow(number, schema), "placed")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(fit).alias("fit")).collect()
    most = percent * sum(r["fit"] for r in sizes) // 100
    begun, before = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        begun[r["part"]], before = before, before + r["n"]
    spark = docs.sparkSession
    starts = spark.createDataFrame(list(begun.items()), "part int, before long")
    rank = F.col("before") + F.col("inside")
    return placed.join(F.broadcast(starts), "part").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(fit & (rank <= most), rank).alias("rank")
    )
