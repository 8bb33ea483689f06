"""Sharding by a Hilbert curve over metadata.

Several dimensions of a document are quantised to `bits` bits each; the point so made has an index
on a Hilbert curve, and the documents in the order of that index are cut into shards of equal
numbers of rows. Neighbours on the curve are near in every dimension, so a shard covers a small
range of each and a reader can skip files by any of them.

Numbers are quantised by the quantiles of a sketch of fixed size over all rows, texts by the exact
quantiles of all rows; their first `MOST_CHARS` characters order them. Ties on the curve are broken by the
row's number, so equal documents, were they a third of all, are dealt out like any others, and
shards differ by one row at most. Null values come first in their dimension. Null text has no
bytes; `size` is the bytes of the text and one more. Repeated rows are placed each for itself. An
empty table gives an empty result. Dimensions that `docs` lacks count as null.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sessionlake.llm.common import quoted
from sessionlake.session import keep

SHARDS, BITS = 16, 8
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")
#: Rows that come before a row in its part have the low bits of Spark's row numbers.
LOW = 33
#: Characters that order the values of a text dimension.
MOST_CHARS = 2000


def curve_index(point: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the curve of each row of `point` (numbers below 2^bits, a column per dimension).

    From the top bit down, a dimension whose bit is set turns the lower bits of the first dimension
    over, and one whose bit is clear swaps them with the first's; the Gray code of the result, its
    bits interleaved, is the index."""
    x = point.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(n):
            turned = (x[k] >> level & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(turned, low, swap)
            if k:
                x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    over = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        over ^= np.where(x[n - 1] >> level & 1, (1 << level) - 1, 0)
    x ^= over
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            index = index << 1 | (x[k] >> level & 1)
    return index


def as_ordered(df: DataFrame, name: str) -> Column:
    """The column as a number, or as text where it is no number or time."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.col(name).cast("double")
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.substring(F.col(name).cast("string"), 1, MOST_CHARS)


def text_bounds(read: DataFrame, name: str, count: int) -> list[str]:
    """At most `count` values that cut a text column into parts of like many rows, each whole value in
    one part. Every value counts, with all its rows: values are put in order over many tasks, and
    only those that a cut falls on come to the driver."""
    values = read.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    ordered = values.repartitionByRange(name).sortWithinPartitions(name)
    ordered = keep(ordered.withColumn("at", F.monotonically_increasing_id()), "values")
    few = sorted(r[0] for r in ordered.select(name).limit(count + 1).collect())
    if len(few) <= count:
        return few
    part = F.shiftrightunsigned("at", LOW).alias("part")
    begun, total = [], 0
    for row in ordered.groupBy(part).agg(F.sum("n").alias("n")).orderBy("part").collect():  # one for each task that sorted
        begun.append((row["part"], total))
        total += row["n"]
    parts = read.sparkSession.createDataFrame(begun, "part long, begun long")
    within = Window.partitionBy("part").orderBy("at")
    summed = ordered.withColumn("part", part).join(F.broadcast(parts), "part").withColumn(
        "upto", F.col("begun") + F.sum("n").over(within)
    )
    cuts = [F.least(F.expr(f"({upto} * {count + 1}) div {total}"), F.lit(count)) for upto in ("upto", "(upto - n)")]
    return sorted(r[0] for r in summed.filter(cuts[0] > cuts[1]).select(name).collect())


def coded(values, bounds: list) -> np.ndarray:
    """The part of each value, from 1; 0 for none."""
    import pandas as pd

    if values.dtype != object:
        held = np.searchsorted(np.array(bounds, float), values.fillna(0).to_numpy(), side="left")
        return np.where(values.isna(), 0, 1 + held)
    which, different = pd.factorize(values)
    parts = np.array([*(1 + bisect_left(bounds, v) for v in different), 0], np.int64)
    return parts[which]


def placed(
    docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS,
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The columns `carry` of every document with `size`, `text_crc32`, `curve` (its index), `shard`
    and `slot` (its place in the shard, from 0)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    names = [f"d{k}" for k in range(len(dimensions))]
    read = docs.select(
        F.struct(*[quoted(c) for c in carry]).alias("own"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        *[as_ordered(docs, d).alias(n) for d, n in zip(dimensions, names, strict=True)],
    )
    read = keep(read.withColumn("row", F.monotonically_increasing_id()), "metadata")
    marks = [k / ((1 << bits) - 2) for k in range(1, (1 << bits) - 2)]
    texts = {n for n in names if isinstance(read.schema[n].dataType, T.StringType)}
    numbers = [F.percentile_approx(n, marks, 10_000).alias(n) for n in names if n not in texts]
    found = read.agg(F.count(F.lit(1)), *numbers).first().asDict()
    bounds = [text_bounds(read, n, len(marks)) if n in texts else list(found[n] or []) for n in names]

    @F.pandas_udf("long")
    def curve(*columns):
        import pandas as pd

        codes = [coded(c, b) for c, b in zip(columns, bounds, strict=True)]
        return pd.Series(curve_index(np.stack(codes, 1), bits))

    on_curve = read.select("own", "size", "text_crc32", "row", curve(*names).alias("curve"))
    ordered = on_curve.repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")
    ordered = keep(ordered.drop("row").withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("at", LOW).alias("part")
    begun, total = [], 0
    for row in ordered.groupBy(part).count().orderBy("part").collect():  # one for each task that sorted
        begun.append((row["part"], total))
        total += row["count"]
    parts = docs.sparkSession.createDataFrame(begun, "part long, begun long")
    ranked = ordered.withColumn("part", part).join(F.broadcast(parts), "part")
    rank = F.col("begun") + F.col("at").bitwiseAND(F.lit((1 << LOW) - 1))
    ranked = ranked.withColumn("rank", rank)
    count = max(1, total)
    shard = F.expr(f"(rank * {shards}) div {count}")
    first = F.expr(f"(shard * {count} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select(
        "own.*", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"),
    )


def write_shards(docs: DataFrame, folder: str, **how) -> None:
    """Writes the documents, a folder per shard, in the order of the curve; Parquet's own ranges per
    column then let a reader skip what it does not need."""
    whole = placed(docs, carry=docs.columns, **how)
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
