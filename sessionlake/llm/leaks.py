"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's windows.

A-Z become a-z and words are runs of letters, digits and everything beyond ASCII. A window is ten
words of an item in a row; an item of fewer words, but not none, is one window. The automaton holds
all windows as text with single blanks between words and at both ends, so a document, brought to the
same form, is read through it once, and a match falls on whole words. Matches are turned back into
words, and on request into places in the text as it came.

The benchmark does not grow with the corpus. Its size is measured; above `most_bytes` of window text
its items are dealt into as many automata as needed, each run over the documents by itself, and
what they find of a document is put together.

Null text has no words. Items without words are never found. Repeated items count once for each id;
null item ids are left out of the list of ids but their windows still hit. Rows of `docs` that
repeat are scanned each for itself. Only `doc_id` and `text`, `item_id` and `text` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import fresh, id_and_text, quoted, slices, small_batches

WINDOW = 10
MOST_BYTES = 64 << 20

#: Bytes to the form that is matched: A-Z to a-z, other ASCII than letters and digits to blanks.
FORM = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FORM).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    if not words:
        return []
    return [words[k : k + size] for k in range(max(1, len(words) - size + 1))]


def framed(words: list[bytes]) -> str:
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "


class Finder:
    """Windows to the items they come from, in one automaton."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        found: dict[str, tuple[int, set[str]]] = {}
        for name, text in items:
            for window in windows_of(words_of(text), size):
                _, names = found.setdefault(framed(window), (len(window), set()))
                if name is not None:
                    names.add(name)
        for key, (length, names) in found.items():
            self.auto.add_word(key, (length, frozenset(names)))
        self.any = bool(found)
        if self.any:
            self.auto.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, past last), merged, and the items found."""
        if not self.any or not words:
            return [], set()
        text = framed(words)
        matches = list(self.auto.iter(text))
        if not matches:
            return [], set()
        # Every word ends before a blank: the place of a blank tells how many words came before.
        sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        blanks = np.cumsum(sizes + 1)
        runs, names = [], set()
        for end, (length, own) in matches:
            past = int(np.searchsorted(blanks, end)) + 1
            runs.append((past - length, past))
            names |= own
        merged: list[list[int]] = []
        for low, high in sorted(runs):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        return [(a, b) for a, b in merged], names


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words to (start, end) in characters of the text as it came."""
    if not runs:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[low][0], places[high - 1][1]) for low, high in runs]


def dealt(benchmark: DataFrame, most_bytes: int, size: int = WINDOW) -> list[list[tuple[str | None, str]]]:
    """The benchmark's items in groups whose windows are at most about `most_bytes` of text."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * size
    parts = max(1, -(-whole // most_bytes))
    if parts == 1:
        return [[(r.item_id, r.text) for r in items.collect()]]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [[(r.item_id, r.text) for r in items.where(part == k).collect()] for k in range(parts)]


def scanned(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids), spans (start, end in characters)."""
    docs = id_and_text(docs).withColumn("row", F.monotonically_increasing_id())
    spark = docs.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType(
        [
            docs.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()),
            T.StructField("runs", span), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span),
        ]
    )
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def one(finder) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = finder.value
            for batch in slices(batches):
                counts, hits, items, places = [], [], [], []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    runs, names = tool.scan(words)
                    counts.append(len(words))
                    hits.append([{"start": a, "end": b} for a, b in runs])
                    items.append(sorted(names))
                    places.append([{"start": a, "end": b} for a, b in spans(text, runs)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(hits, pairs),
                        pa.array(items, pa.list_(pa.string())), pa.array(places, pairs),
                    ],
                    schema.names,
                )

        return docs.mapInArrow(run, schema)

    found = [one(spark.sparkContext.broadcast(Finder(group))) for group in dealt(benchmark, most_bytes)]
    if len(found) > 1:
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        merged = every.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            _merged(F.flatten(F.collect_list("runs"))).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        )
    else:
        merged = found[0]
    width = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return merged.select("doc_id", "n_words", width.alias("n_hit"), "items", "spans")


def _merged(runs):
    """Sorted runs with those that overlap or touch made one."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda done: F.element_at(done, -1)

    def step(done, run):
        joined = F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], run["end"]).alias("end"))
        meets = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= run["start"])
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(done, F.array(F.struct(run["start"].alias("start"), run["end"].alias("end"))))
        )

    return F.aggregate(F.array_sort(runs), none, step)


def report(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per document: how many words are hit, how many items occur, and a digest of their ids."""
    return scanned(docs, benchmark, most_bytes).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("hit_spans"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents that no window occurs in, with the columns they came with, filtered where they
    lie."""
    small_batches(docs)
    finders = [docs.sparkSession.sparkContext.broadcast(Finder(g)) for g in dealt(benchmark, most_bytes)]
    text, hit, own = fresh(docs, "whole"), fresh(docs, "hit"), docs.columns

    def marks(finder):
        @F.arrow_udf("boolean")
        def leaks(texts: pa.Array) -> pa.Array:
            return pa.array([bool(finder.value.scan(words_of(t.as_py()))[0]) for t in texts], pa.bool_())

        return leaks

    kept = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    for finder in finders:
        kept = kept.withColumn(hit, marks(finder)(F.col(text))).where(~F.col(hit)).drop(hit)
    return kept.select(*map(quoted, own))
