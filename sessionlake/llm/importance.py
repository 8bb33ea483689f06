"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and pairs of neighbouring words (A-Z as a-z; a pair of equal words is one and the same pair,
whatever the word) are hashed into 2^20 buckets. The raw model counts all documents, the target
model the labelled good ones. A bucket's log ratio is target over raw with one count added to both
at the target's scale, so rare words say nothing and words that good texts avoid say much. From the
ratios of a document a few sums are taken (all of it, and what falls below a floor, for words and
pairs), and a logistic fit on labelled documents that the target model has not seen turns them into
one log weight: of the odds that a document is drawn from the target. The k documents with the
largest weight plus Gumbel noise are kept, which samples without replacement by weight; k is the
expected number of target documents, the sum of their chances. The noise is a hash of the document
and the seed, so a run repeats itself.

Labels are used up to `most_labels` rows, those with the least hash of their id; a third of them is
for the fit. Everything else reads every document.

Null text counts as empty; a document without words has no evidence for it and is never kept. Rows
that repeat have the same key and are kept or rejected together; so are all that tie at the last
place. Labels with a null in any column are not used, and of several for a document the worst
counts. Without labels of both kinds there is no target, and every document with words is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import fresh, quoted, slices, small_batches, task_number
from sessionlake.llm.words import mix, word_hashes
from sessionlake.session import keep

BITS, BLOCK = 20, 1 << 12
FLOORS = (0.7, 1.5)
MOST_LABELS = 40_000
TRAITS = 4 * len(FLOORS) + 2
#: Partial sums of the counts are first added in this many groups, so no task reads all of them.
SPREAD = 64


def grams(values: pa.Array) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Buckets of all words, then of all pairs; the text each is in; how many are words; words in
    each text."""
    hashes, counts = word_hashes(values)
    text = np.repeat(np.arange(len(counts)), counts)
    pairs = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    pairs[hashes[:-1] == hashes[1:]] = np.uint64(0x5851F42D4C957F2D)
    inside = text[:-1] == text[1:]
    both = np.concatenate([mix(hashes + np.uint64(1)), pairs[inside]])
    return (
        (both >> np.uint64(64 - BITS)).astype(np.int64),
        np.concatenate([text, text[1:][inside]]), len(hashes), counts,
    )


def sampled_labels(labels: DataFrame, most: int, seed: int) -> DataFrame:
    """(label_id, good, fold) of at most `most` documents; fold 0 is held out for the fit."""
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return (
        labels.select("doc_id", "quality", "toxic").dropna()
        .groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good"))
        .orderBy(rank, "doc_id").limit(most)
        .select(F.col("doc_id").alias("label_id"), "good", F.pmod(rank, F.lit(3)).cast("int").alias("fold"))
    )


def _sum(group: pa.Table) -> pa.Table:
    raw, target = (
        np.sum([np.frombuffer(x.as_buffer(), "<i8") for x in group.column(c)], axis=0)
        for c in ("raw", "target")
    )
    return pa.table(
        {
            "block": group.column("block").slice(0, 1), "part": group.column("part").slice(0, 1),
            "raw": pa.array([raw.tobytes()], pa.binary()), "target": pa.array([target.tobytes()], pa.binary()),
        }
    )


def counted(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every bucket over all `texts` (text, in_target) and over those in the target. What
    reaches the driver is two numbers a bucket, however many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in slices(batches):
            bucket, text, _, _ = grams(batch.column("text"))
            raw += np.bincount(bucket, minlength=1 << BITS)
            chosen = batch.column("in_target").to_numpy(zero_copy_only=False)
            if chosen.any():
                target += np.bincount(bucket[chosen[text]], minlength=1 << BITS)
        part = task_number() % SPREAD
        for block in range(len(raw) // BLOCK):
            at = slice(block * BLOCK, (block + 1) * BLOCK)
            if raw[at].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([part]), pa.array([raw[at].tobytes()], pa.binary()), pa.array([target[at].tobytes()], pa.binary())],
                    ["block", "part", "raw", "target"],
                )

    kind = "block long, part long, raw binary, target binary"
    sums = texts.mapInArrow(run, kind).groupBy("block", "part").applyInArrow(_sum, kind)
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for row in sums.groupBy("block").applyInArrow(_sum, kind).collect():
        at = slice(row.block * BLOCK, (row.block + 1) * BLOCK)
        raw[at], target[at] = np.frombuffer(row.raw, "<i8"), np.frombuffer(row.target, "<i8")
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    scale = target.sum() / max(1.0, raw.sum())
    return np.log((target + 1) / (raw * scale + 1)).astype(np.float32)


def traits(values: pa.Array, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the models say of each text, a row each, and its number of words."""
    bucket, text, words, counts = grams(values)
    found, n = ratios[bucket], len(counts)
    size = np.maximum(1, counts)
    columns = []
    for floor in FLOORS:
        low = np.minimum(0, found + floor)
        for part in (slice(0, words), slice(words, None)):
            total = np.bincount(text[part], low[part], minlength=n)
            columns += [total / size, np.maximum(total, -30)]
    columns += [np.bincount(text, found, minlength=n) / (2 * size), np.log(size)]
    return np.stack(columns, 1), counts


@dataclass(frozen=True)
class Fit:
    """Traits to log weight."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.mean) / self.spread, -8, 8)
        return scaled @ self.weights[:-1] + self.weights[-1]


def fitted(rows: np.ndarray, good: np.ndarray, pull: float = 0.1) -> Fit:
    """Logistic regression with a slight pull to zero, by Newton's steps, each halved until it gains."""
    mean, spread = rows.mean(0), rows.std(0) + 1e-9
    x = np.c_[np.clip((rows - mean) / spread, -8, 8), np.ones(len(rows))]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, np.where(good > 0, -z, z)).sum() + pull / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    here = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (good - p) - pull * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull * np.eye(len(w)), slope)
        while (there := loss(w + step)) > here and np.abs(step).max() > 1e-9:
            step /= 2
        if here - there < 1e-6:
            break
        w, here = w + step, there
    return Fit(mean, spread, w)


def gumbel(salt: np.ndarray) -> np.ndarray:
    chance = ((mix(salt.view(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(-np.log(chance))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest number of a column, exactly, by counts in ever narrower ranges."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    here = values
    while low < high:
        width = (high - low) / 512
        if not low < low + width < high:
            break
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(511))
        bins = here.groupBy(bin_.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in sorted(bins.collect(), key=lambda r: -r.bin):
            if row.n >= k:
                break
            k -= row.n
        low, high = row.low, row.high
        here = values.where(F.col(column).between(low, high))
    return low if k > 1 or low == high else high


@dataclass(frozen=True)
class Sampler:
    """What a task needs to weigh documents; the size is set by the buckets."""

    ratios: np.ndarray
    fit: Fit | None
    least: float

    def keys(self, texts: pa.Array, salt: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log weight, and key; none without words."""
        rows, words = traits(texts, self.ratios)
        weight = self.fit(rows) if self.fit else np.zeros(len(rows))
        weight = np.where(words > 0, weight, -np.inf)
        return weight, weight + gumbel(salt.to_numpy(zero_copy_only=False))


def _salted(docs: DataFrame, seed: int) -> tuple:
    text = F.coalesce(F.col("text"), F.lit(""))
    return text.alias("text"), F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("salt")


def resample(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, seed: int = 17) -> tuple[DataFrame, Sampler]:
    """(doc_id, weight, key, kept) of every document, and the sampler that decides so."""
    spark = small_batches(docs).sparkSession
    marks = keep(sampled_labels(labels, most_labels, seed), "labels")
    known = F.broadcast(marks)  # at most `most_labels` rows of an id and two small numbers
    text, salt = _salted(docs, seed)
    read = docs.select(F.col("doc_id").alias("doc_id"), text, salt)
    joined = read.join(known, read["doc_id"] == known["label_id"], "left")
    in_target = F.coalesce(F.col("good") & (F.col("fold") > 0), F.lit(False)).alias("in_target")
    ratios = log_ratios(*counted(joined.select("text", in_target)))
    shared = spark.sparkContext.broadcast(ratios)
    schema = T.StructType(
        [
            read.schema["doc_id"], T.StructField("words", T.LongType()), T.StructField("noise", T.DoubleType()),
            T.StructField("traits", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, words = traits(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(words.astype(np.int64)),
                    pa.array(gumbel(batch.column("salt").to_numpy(zero_copy_only=False))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, TRAITS), pa.int32()), pa.array(rows.ravel())),
                ],
                schema.names,
            )

    seen = keep(read.mapInArrow(run, schema), "traits")
    held = seen.join(known, seen["doc_id"] == known["label_id"]).where("fold = 0 and words > 0")
    held = held.groupBy("label_id").agg(F.first("traits").alias("traits"), F.first("good").alias("good")).collect()
    good = np.array([r.good for r in held], float)
    fit = None
    if good.any() and not good.all():
        fit = fitted(np.array([r.traits for r in held]), good)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("traits").flatten().to_numpy(zero_copy_only=False).reshape(-1, TRAITS)
            weight = fit(rows) if fit else np.zeros(len(rows))
            words = batch.column("words").to_numpy(zero_copy_only=False)
            weight = np.where(words > 0, weight, -np.inf)
            noise = batch.column("noise").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(weight), pa.array(weight + noise)], ["doc_id", "weight", "key"]
            )

    weighed = keep(
        seen.mapInArrow(weigh, T.StructType([read.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in ("weight", "key"))])),
        "weights",
    )
    able = weighed.where(F.col("key") > float("-inf"))
    chance = F.lit(1.0) if fit is None else 1 / (1 + F.exp(-F.col("weight")))
    k = int(round(able.agg(F.coalesce(F.sum(chance), F.lit(0.0))).first()[0]))
    least = kth_largest(able, "key", k) if k else float("inf")
    kept = (F.col("key") >= least) & (F.col("key") > float("-inf"))
    return weighed.withColumn("kept", kept), Sampler(ratios, fit, least)


def resampled(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, seed: int = 17) -> DataFrame:
    """The kept documents with the columns they came with, filtered where they lie."""
    _, sampler = resample(docs, labels, most_labels, seed)
    shared = docs.sparkSession.sparkContext.broadcast(sampler)
    own, text, salt, key = docs.columns, fresh(docs, "whole"), fresh(docs, "salt"), fresh(docs, "key")
    columns = _salted(docs, seed)

    @F.arrow_udf("double")
    def keys(texts: pa.Array, salts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts, salts], ["text", "salt"])
        parts = [shared.value.keys(p.column("text"), p.column("salt"))[1] for p in slices(iter([batch]))]
        return pa.array(np.concatenate([*parts, np.zeros(0)]))

    marked = docs.withColumns({text: columns[0], salt: columns[1]})
    marked = marked.withColumn(key, keys(F.col(text), F.col(salt)))
    return marked.where((F.col(key) >= sampler.least) & (F.col(key) > float("-inf"))).select(*map(quoted, own))
