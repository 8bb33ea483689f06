"""Groups of spelling variants, found through a reduced alphabet.

`counted` takes the words of all texts: maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF; only A-Z are
lower-cased) of at least `min_chars` code points, with how often each stands there.

`near_pairs` finds all pairs of words one edit apart. Letters are hashed to a few symbols. Of each reduced
word the full neighbourhood of one edit is made (itself, all deletions, replacements and insertions over
the symbols) and joined with the reduced vocabulary; what meets is verified on the words themselves. As
an edit lies either behind the first `min_chars // 2` letters or before the last as many, a neighbour
also carries the end of the word that its edit leaves alone, so that even where reduced words are common
few words meet. A pair whose words begin alike counts where the first letters are carried, any other
where the last are: each pair is met once from either side, without a pass that removes doubles.

`grouped` gives each word its form (the near word of most occurrences, ties by code points, if it has at
least `factor` times as many) and its root, the last word that forms lead to. Counts rise by `factor`
at each step, so doubling steps ends after a handful of rounds.

Null and empty texts have no words; repeated rows count each; a null id counts as an empty one; only
`doc_id` and `text` are read; an empty table gives no rows. A run of any length is a word. Ties of counts go
to the smaller word. A word that is part of every document is one row from the first partial count on.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import slices, small_batches
from sessionlake.llm.words import mix
from sessionlake.session import keep

MIN_CHARS, MIN_COUNT, FACTOR, SYMBOLS = 6, 5, 5, 4

#: Bytes of words whose neighbours are made at a time, where no single one is longer.
LETTERS_AT_ONCE = 1 << 16

BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def symbols_of(symbols: int) -> np.ndarray:
    """The symbol, from 1, that each letter is hashed to."""
    return np.array([zlib.crc32(chr(c).encode()) % symbols + 1 for c in range(0x100)], np.uint64)


def counted(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int | None = None
) -> DataFrame:
    """word, n. With `slip`, a run whose checksum (with its document's id) that number divides loses one
    letter: misspellings made up in a known way, for a trial of what finds them."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{min_chars},}})"), F.lit(1)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run.alias("run"))
    word = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    if slip:
        h = F.crc32(F.concat("doc_id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        shorter = F.concat(
            F.substr("word", F.lit(1), at), F.substr("word", at + F.lit(2), F.length("word"))
        )
        word = F.when(h % slip == 0, shorter).otherwise(F.col("word"))
        runs = runs.withColumn("word", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    words = runs.select(word.alias("word")).filter(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words in a row, and where each word begins and the last ends."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = "".join(words.to_pylist()).encode("utf-32-le")
    return np.frombuffer(flat, "<u4"), np.concatenate([[0], np.cumsum(lengths)])


def _rolling(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, 2... letters of each word, words in a row, each one place longer."""
    size = int(lengths.max()) + 2
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, BASE, np.uint64)]))
    inside = np.arange(len(values)) - np.repeat(begins, lengths)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[inside])])
    places = np.arange(int((lengths + 1).sum())) - np.repeat(np.arange(len(lengths)), lengths + 1)
    return sums[places] - np.repeat(sums[begins], lengths + 1)


def _ends(codes: np.ndarray, offsets: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the first letters of each word, and of the last ones."""
    first, last = np.full(len(offsets) - 1, np.uint64(1)), np.full(len(offsets) - 1, np.uint64(2))
    for k in range(anchor):
        first = mix(first * BASE + codes[offsets[:-1] + k].astype(np.uint64))
        last = mix(last * BASE + codes[offsets[1:] - anchor + k].astype(np.uint64))
    return first, last


def keys_held(words: pa.Array, anchor: int, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """The two keys that each word is found by: its reduced form with its first letters, and with its last."""
    codes, offsets = _codes(words)
    lengths = np.diff(offsets)
    rolled = _rolling(symbols_of(symbols)[codes & 0xFF], offsets[:-1], lengths)
    whole = rolled[np.cumsum(lengths + 1) - 1]
    first, last = _ends(codes, offsets, anchor)
    return mix(whole ^ first), mix(whole ^ last)


def neighbourhood(words: pa.Array, anchor: int, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Number of the word, and key, of all that one edit makes of each reduced word, and of itself, with
    the end that the edit leaves alone. Hashes of what stands before and behind an edit are put together,
    so a long word costs no more than its edits."""
    codes, offsets = _codes(words)
    lengths = np.diff(offsets)
    values = symbols_of(symbols)[codes & 0xFF]
    rolled = _rolling(values, offsets[:-1], lengths)
    number = np.repeat(np.arange(len(lengths)), lengths + 1)
    place = np.arange(len(number)) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1)
    power = np.multiply.accumulate(
        np.concatenate([[np.uint64(1)], np.full(int(lengths.max()) + 2, BASE, np.uint64)])
    )
    back = np.uint64(pow(int(BASE), -1, 1 << 64))
    whole = rolled[np.cumsum(lengths + 1) - 1][number]
    before, behind = rolled, whole - rolled
    first, last = _ends(codes, offsets, anchor)
    end = np.where(place >= anchor, first[number], last[number])
    inside = np.flatnonzero(place < lengths[number])
    own = values[offsets[:-1][number[inside]] + place[inside]]
    rest = behind[inside] - own * power[place[inside]]
    found, numbers = [mix((before[inside] + rest * back) ^ end[inside])], [number[inside]]
    for sign in range(1, symbols + 1):
        found.append(mix((before[inside] + np.uint64(sign) * power[place[inside]] + rest) ^ end[inside]))
        numbers.append(number[inside])
        found.append(mix((before + np.uint64(sign) * power[place] + behind * BASE) ^ end))
        numbers.append(number)
    key, of = np.concatenate(found), np.concatenate(numbers)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return of[new], key[new]


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return slices(batches, "word", LETTERS_AT_ONCE)


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS, symbols: int = SYMBOLS) -> DataFrame:
    """id (of the word), near, near_n: all pairs one edit apart, from either side. `words` has `id`, `word` and `n`,
    written, all different and of `min_chars` code points at least."""
    anchor = min_chars // 2

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_runs(batches):
            first, last = keys_held(batch.column("word"), anchor, symbols)
            ids = batch.column("id").to_numpy()
            for key, by_first in ((first, True), (last, False)):
                columns = [pa.array(key.view(np.int64)), pa.array(ids), pa.array(np.full(len(ids), by_first))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "near_id", "by_first"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_runs(batches):
            of, key = neighbourhood(batch.column("word"), anchor, symbols)
            ids = batch.column("id").to_numpy()[of]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids)], ["key", "id"])

    narrow = small_batches(words.select("id", "word"))
    held = narrow.mapInArrow(hold, "key long, near_id long, by_first boolean")
    made = narrow.mapInArrow(make, "key long, id long")
    met = made.join(held, "key").filter("id <> near_id").select("id", "near_id", "by_first")
    alike = F.substr("word", F.lit(1), F.lit(anchor)) == F.substr("near", F.lit(1), F.lit(anchor))
    others = words.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return (
        met.join(words.select("id", "word"), "id")
        .join(others, "near_id")
        .filter((F.col("by_first") == alike) & (F.levenshtein("word", "near", 1) == 1))
        .select("id", "near", "near_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that steps from word to form lead to. No rings."""
    reached, moving = keep(forms.select("word", F.col("form").alias("root")), "roots"), True
    while moving:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = keep(
            reached.select("word", "root").join(ahead, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        moving = not reached.filter("moved").isEmpty()
    return reached.select("word", "root")


def grouped(
    words: DataFrame, min_chars: int = MIN_CHARS, factor: int = FACTOR, symbols: int = SYMBOLS
) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words that `counted` gives."""
    words = keep(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    met = near_pairs(words, min_chars, symbols).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    taken = -F.col("best.less") >= factor * F.col("n")
    formed = keep(
        words.join(met, "id", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    led = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
