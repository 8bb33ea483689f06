"""Substring dedup by hashed units: lines, paragraphs, the sentences of lines, or all of sentences,
lines and texts.

A text is cut into units: lines, paragraphs (what stands between empty lines), or lines cut further
where a sentence ends. A unit is normalised (white space gone at the ends and one blank inside, lower
case) and hashed to 16 bytes. Of all equal units in the corpus the earliest stays: the one in the
document with the least id (null last; among equal ids the least fingerprint), and there the one
that stands first. The others are cut out of their documents with the white space after them; where
they stood is kept as (start, end) in characters of the text as it came.

Short units repeat by chance. One of fewer than `min_words` words is therefore hashed with what
stands before it, back to the last long unit: it goes only where it follows the same words as
somewhere else, and never where no long unit stands before it.

The unit `nested` is that of the registered query. To the sentences come, as units of their own: runs
of short sentences, joined from where the run begins until they have `min_words` words (the next
short ones are hashed with them where nothing long stands before); lines of as many words; and the
whole text, of any length, so that copies always go. Units of one text then overlap: of the spans
found, those inside others are dropped and the rest are told without what an earlier one covers.

64 bits of the hash decide which units can repeat at all; just those are grouped by the whole
hash. Minima and counts are taken before the shuffle, so a line that stands in a third of all
documents is one row a task, and joins meet it in parts that Spark can split. Null text stays null
and has no units. Rows with equal doc_id and text are one document given several times: all get the
same result. Only `doc_id` and `text` are read; a document's other columns are carried along.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import fresh, id_and_text, quoted, slices
from sessionlake.session import keep

UNIT, NESTED, MIN_WORDS = "sentence", "nested", 6

#: What parts two units.
CUTS = {
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n(?:[^\S\n]*\n)+"),
    "sentence": re.compile(r"(?<=[.!?])[^\S\n]+|\n"),
}


def units_of(text: str, unit: str = UNIT, min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(digest, start, end) of the units that may go; `end` is past the cut after the unit."""
    found, at, before = [], 0, b""
    cuts = [m.span() for m in CUTS[unit].finditer(text)]
    for low, high in [*cuts, (len(text), len(text))]:
        words = text[at:low].split()
        if words and (before or len(words) >= min_words):
            own = " ".join(words).lower().encode("utf-8", "surrogatepass")
            before = hashlib.md5(own if len(words) >= min_words else before + own).digest()
            found.append((before, at, high))
        at = high
    return found


def hashed(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).lower().encode("utf-8", "surrogatepass")).digest()


def nested_of(text: str, min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """Like `units_of`, for sentences, joined runs of short sentences, lines and the text."""
    found: list[tuple[bytes, int, int]] = []
    places: dict[bytes, list[tuple[int, int]]] = {}

    def add(digest: bytes, start: int, end: int) -> None:
        found.append((digest, start, end))
        places.setdefault(digest, []).append((start, end))

    at, before, run, run_at = 0, b"", [], 0
    for low, high in [*(m.span() for m in CUTS["sentence"].finditer(text)), (len(text), len(text))]:
        words = text[at:low].split()
        if len(words) >= min_words:
            before, run = hashed(words), []
            add(before, at, high)
        elif words:
            if before:
                own = " ".join(words).lower().encode("utf-8", "surrogatepass")
                before = hashlib.md5(before + own).digest()
                add(before, at, high)
            run_at = run_at if run else at
            run = run + words
            if len(run) >= min_words:
                joined, run = hashed(run), []
                before = before or joined
                add(joined, run_at, high)
        at = high
    at = 0
    for low, high in [*(m.span() for m in CUTS["line"].finditer(text)), (len(text), len(text))]:
        words = text[at:low].split()
        if len(words) >= min_words:
            digest = hashed(words)
            # A line that is one unit, or runs into an equal one, is not another occurrence.
            held = places.get(digest, [])
            k = bisect_left(held, (high,))
            if not k or held[k - 1][1] <= at:
                found.append((digest, at, high))
        at = high
    words = text.split()
    # A unit with all words of the text stands for it already.
    if words and (digest := hashed(words)) not in {d for d, _, _ in found}:
        found.append((digest, 0, len(text)))
    return found


def apart(spans: list[dict]) -> list[dict]:
    """Spans that overlap, as spans that do not and cover the same."""
    out, reach = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] > reach:
            out.append({**s, "start": max(s["start"], reach)})
            reach = s["end"]
    return out


def told_apart() -> Column:
    """Tells texts under one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def units(docs: DataFrame, unit: str = UNIT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, fp, high, low, start, end) of every unit that may go, written once; `high` and `low` are
    the halves of its digest."""
    docs = id_and_text(docs).withColumn("fp", told_apart())
    schema = T.StructType(
        [
            docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("fp", "high", "low")),
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, digests, starts, ends = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own_units = nested_of(text, min_words) if unit == NESTED else units_of(text, unit, min_words)
                for digest, start, end in own_units:
                    row.append(k), digests.append(digest), starts.append(start), ends.append(end)
            halves, rows = np.frombuffer(b"".join(digests), "<i8"), pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows), batch.column("fp").take(rows),
                    pa.array(halves[::2]), pa.array(halves[1::2]),
                    pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
                ],
                schema.names,
            )

    return keep(docs.mapInArrow(run, schema), "units")


def repeated(found: DataFrame) -> DataFrame:
    """(doc_id, fp, start, end, first_id) of the units that go; `first_id` has the one that stays."""
    marks = found.groupBy(F.col("high").alias("mark")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    # Written, so that the exchange of all units can go before the rest begins.
    found = keep(found.join(marks, F.col("high") == F.col("mark"), "left_semi"), "likely")
    void = F.col("doc_id").isNull().alias("void")
    place = F.struct(void, "doc_id", "fp", "start")
    # Rows that are one document several times must not make their units look repeated.
    firsts = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = firsts.where(~F.col("first").eqNullSafe(F.col("last"))).select("high", "low", "first")
    return (
        found.join(firsts, ["high", "low"])
        .where(~place.eqNullSafe(F.col("first")))
        .select("doc_id", "fp", "start", "end", F.col("first.doc_id").alias("first_id"))
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for low, high in spans:
        out.append(text[at:low])
        at = high
    return "".join([*out, text[at:]])


def flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("gone")
        spans = pa.array([apart(s) for s in column.to_pylist()], column.type)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), spans], ["doc_id", "fp", "gone"])


def without_repeats(docs: DataFrame, unit: str = UNIT, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated units cut out of `text`, and two columns more: `removed`, the
    spans cut, and `first_ids`, the documents that keep what was cut, in the same order."""
    gone = repeated(units(docs, unit, min_words)).distinct()
    spans = gone.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_id"))).alias("gone"))
    if unit == NESTED:
        spans = spans.mapInArrow(flattened, spans.schema)
    spans = spans.withColumnsRenamed({"doc_id": "gone_id", "fp": "gone_fp"})
    mark, own = fresh(docs, "fp"), docs.columns
    marked = docs.withColumn(mark, told_apart())
    same = (marked[mark] == spans["gone_fp"]) & marked["doc_id"].eqNullSafe(spans["gone_id"])

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(
            [
                cut(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()]) if t.is_valid and s.is_valid else t.as_py()
                for t, s in zip(texts, spans, strict=True)
            ],
            pa.string(),
        )

    pairs = F.transform("gone", lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end")))
    joined = marked.join(spans, same, "left")
    # Documents that lose nothing do not go through Python.
    lost = joined.where(F.col("gone").isNotNull()).withColumn(mark, cleaned(marked["text"], F.col("gone")))
    whole = joined.where(F.col("gone").isNull()).withColumn(mark, marked["text"])
    return lost.unionByName(whole).select(
        *[(F.col(mark) if c == "text" else quoted(c)).alias(c) for c in own],
        F.coalesce(pairs, F.array().cast("array<struct<start:int,end:int>>")).alias("removed"),
        F.coalesce(F.transform("gone", lambda g: g["first_id"]), F.array()).alias("first_ids"),
    )
