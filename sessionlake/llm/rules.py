"""Quality rules with cross-document line frequency.

Words are runs without blank, tab, line feed, vertical tab, form feed and carriage return; lines are
parted by line feeds. Base rules per text: too few words, or too many words in windows of eight that
come twice or more. The method then looks across documents: a line (white space gone at the ends and
one blank inside, lower case) is boilerplate where more than `limit` different documents of its host
hold it, and a document of which less than `least_left` of the words stand outside boilerplate is
depleted. Kept are documents that fail no base rule and are not depleted. Boilerplate lines are cut
out of the texts with the line feeds after them; where they stood is told as (start, end) in
characters of the text as it came. The measures are those of the text as it came.

The host is the `source` of a document. Equal texts of a host count as one document, so copies alone
never make a line boilerplate. The limit is one number for every host and size of corpus.

Null text stays null and has no words and no lines, null hosts are one host. Rows that repeat are
judged each for itself, with the same result. Columns read: `doc_id`, `text`, `source`; a document's
other columns are carried along by `without_boilerplate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import fingerprint, fresh, quoted, slices, small_batches, task_number
from sessionlake.llm.repeats import cut
from sessionlake.session import keep

MIN_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Documents of a host that may hold a line, few enough for hosts of some dozen documents; share of
#: words that must stand outside such lines.
LIMIT, LEAST_LEFT = 10, 0.3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def repeat_words(words: list[np.ndarray]) -> np.ndarray:
    """For each text, given as numbers of its words, how many stand in a window that comes again.

    Windows get exact numbers by doubling: of pairs, of pairs of pairs, and of pairs of those."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    long = np.flatnonzero(lengths >= WINDOW)
    out = np.zeros(len(words), np.int64)
    if not long.size:
        return out
    flat = np.concatenate([words[k] for k in long])
    sizes = lengths[long]
    text = np.repeat(np.arange(len(long)), sizes)
    # The first number holds the text, so windows of different texts never are equal.
    number = np.unique(text * np.int64(flat.max() + 1) + flat, return_inverse=True)[1]
    width = 1
    while width < WINDOW:
        both = number[:-width] * np.int64(len(number) + 1) + number[width:]
        number = np.unique(both, return_inverse=True)[1]
        width *= 2
    # Windows that run over the end of a text are not windows.
    inside = text[: len(number)] == text[WINDOW - 1 :]
    number = number[inside]
    starts = np.flatnonzero(inside)
    again = starts[np.bincount(number)[number] > 1]
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    hit = np.cumsum(cover[:-1]) > 0
    out[long] = np.bincount(text[hit], minlength=len(long))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """Base measures of each document with its own row number, and its lines as (hash of host and
    line, words, start, end); `end` is past the line feed. A hash of the text stands for it where lines
    are counted, `fp` where texts are met again. Written once."""
    read = small_batches(docs).select(
        F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.xxhash64(F.col("source")).alias("host"), F.xxhash64(F.col("text")).alias("print"),
        fingerprint(F.col("text")).alias("fp"),
    )
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType(
        [
            read.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("print", T.LongType()),
            T.StructField("host", T.LongType()), T.StructField("fp", T.BinaryType()),
            *(T.StructField(c, T.LongType()) for c in numbers),
            T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = task_number() << 33
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            raws = [t.encode("utf-8", "surrogatepass") for t in texts]
            words = [r.split() for r in raws]
            every = [w for ws in words for w in ws]
            codes = pd.factorize(pd.Series(every, dtype=object))[0] if every else np.zeros(0, np.int64)
            counts = [len(ws) for ws in words]
            cuts = np.cumsum(counts)[:-1]
            chars = [len(t) - sum(map(t.count, BLANKS)) for t in texts]
            symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
            doubled, lines, sizes, starts, ends = [], [], [], [], []
            hosts = batch.column("host").to_pylist()
            for text, raw, host in zip(texts, raws, hosts, strict=True):
                seen, twice, own, lens, low, high, at = set(), 0, [], [], [], [], 0
                # Places are in characters, words in bytes.
                for line, chars_of in zip(raw.split(b"\n"), map(len, text.split("\n")), strict=True):
                    parts = line.split()
                    if parts:
                        twice += line in seen
                        seen.add(line)
                        own.append(b" ".join(parts).lower())
                        lens.append(len(parts))
                        low.append(at)
                        high.append(min(at + chars_of + 1, len(text)))
                    at += chars_of + 1
                doubled.append(twice)
                lines.append((host, own))
                sizes.append(lens)
                starts.append(low)
                ends.append(high)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.arange(row, row + batch.num_rows)), batch.column("print"),
                    batch.column("host"), batch.column("fp"),
                    *(
                        pa.array(v, pa.int64())
                        for v in (counts, chars, symbols, doubled, repeat_words(np.split(codes, cuts)))
                    ),
                    hashed(lines), *(pa.array(v, pa.list_(pa.int32())) for v in (sizes, starts, ends)),
                ],
                schema.names,
            )
            row += batch.num_rows

    return keep(read.mapInArrow(run, schema), "measured")


def hashed(lines: list[tuple[int, list[bytes]]]) -> pa.Array:
    """64 bits for each line with its host."""
    import xxhash

    return pa.array(
        [[xxhash.xxh3_64_intdigest(x, host & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for x in own] for host, own in lines],
        pa.list_(pa.int64()),
    )


def found(docs: DataFrame, limit: int, least_left: float) -> DataFrame:
    """(doc_id, host, fp), the base measures, `base_failed`, `kept`, words in boilerplate lines and the
    spans of those lines, for every row of `docs`."""
    seen = measured(docs)
    # A line counts once for each different text; the pairs are made distinct before they are counted.
    pairs = seen.select("print", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    common = keep(pairs.groupBy("line").count().where(F.col("count") > limit).select("line"), "boilerplate")
    each = seen.select("row", F.explode(F.arrays_zip("lines", "sizes", "starts", "ends")).alias("at"))
    each = each.select(
        "row", F.col("at.lines").alias("line"), F.col("at.sizes").alias("size"),
        F.struct(F.col("at.starts").alias("start"), F.col("at.ends").alias("end")).alias("span"),
    )
    lost = each.join(common, "line").groupBy("row").agg(
        F.sum("size").alias("lost"), F.sort_array(F.collect_list("span")).alias("gone")
    )
    seen = seen.drop("lines", "sizes", "starts", "ends", "print")
    joined = seen.join(lost.withColumnRenamed("row", "lost_row"), F.col("row") == F.col("lost_row"), "left")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    boiler = F.coalesce(F.col("lost"), F.lit(0))
    depleted = (F.col("n_words") - boiler) < least_left * F.col("n_words")
    return joined.select(
        "doc_id", "host", "fp", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"),
        boiler.alias("n_boilerplate_words"),
        F.coalesce("gone", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"),
    )


def judged(docs: DataFrame, limit: int = LIMIT, least_left: float = LEAST_LEFT) -> DataFrame:
    """Per document: the base measures, `base_failed`, `kept`, words in boilerplate lines, and
    `removed`, where those lines stand."""
    return found(docs, limit, least_left).drop("host", "fp")


def cleaned(docs: DataFrame, limit: int = LIMIT, least_left: float = LEAST_LEFT) -> DataFrame:
    """All documents with boilerplate lines cut out of `text`, and one column more: `verdict`, which
    holds the columns of `judged`."""
    verdicts = found(docs, limit, least_left).dropDuplicates(["doc_id", "host", "fp"])
    names = [c for c in verdicts.columns if c not in ("host", "fp")]
    verdicts = verdicts.select(
        F.col("doc_id").alias("_own_id"), F.col("host").alias("_own_host"), F.col("fp").alias("_own_fp"),
        F.struct(*names).alias("_verdict"),
    )
    mark, own = fresh(docs, "fp"), docs.columns
    marked = docs.withColumn(mark, F.struct(F.xxhash64(F.col("source")).alias("host"), fingerprint(F.col("text")).alias("fp")))
    same = (
        (marked[mark]["fp"] == verdicts["_own_fp"]) & (marked[mark]["host"] == verdicts["_own_host"])
        & marked["doc_id"].eqNullSafe(verdicts["_own_id"])
    )

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(
            [
                cut(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()]) if t.is_valid else None
                for t, s in zip(texts, spans, strict=True)
            ],
            pa.string(),
        )

    joined = marked.join(verdicts, same)
    # Documents that lose nothing do not go through Python.
    some = F.size("_verdict.removed") > 0
    lost = joined.where(some).withColumn(mark, without(marked["text"], F.col("_verdict.removed")))
    whole = joined.where(~some).withColumn(mark, marked["text"])
    return lost.unionByName(whole).select(
        *[(F.col(mark) if c == "text" else quoted(c)).alias(c) for c in own], F.col("_verdict").alias("verdict")
    )


def without_boilerplate(docs: DataFrame, limit: int = LIMIT, least_left: float = LEAST_LEFT) -> DataFrame:
    """The kept documents with boilerplate lines cut out of `text`, and one column more: `removed`, the
    spans cut."""
    out = cleaned(docs, limit, least_left).where("verdict.kept")
    return out.select(*map(quoted, docs.columns), F.col("verdict.removed").alias("removed"))
