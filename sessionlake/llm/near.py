"""Near-duplicates by ProbMinHash: signatures of weighted shingles, banding, verification.

Shingles are runs of five words (A-Z as a-z, words end at white space); a text of fewer words, but
not none, is one shingle. A shingle that comes c times weighs 1 + ln c. Each shingle sends arrivals
of a Poisson process at the rate of its weight to random components of the signature; a component
keeps whose arrival came first. A shingle is followed only until its next arrival is later than the
latest first arrival of any component, so most are dropped after one. Two signatures agree in a
component with the probability Jaccard similarity of the texts.

Equal texts are one from the start, so copies never meet in pairs. Texts that agree in a whole band
share a bucket. Each text is first compared with one partner, the least among the least members of
its buckets, then with the others of those that are not in its class yet; whatever bucket then still
holds texts of different classes is searched through, block against block, for pairs across
classes, so no link between classes is lost to the shortcut. Every pair is verified on its texts: linked if their
probability Jaccard or the plain Jaccard of their shingle sets is at least `threshold`. At 0.8, a
pair misses all 28 bands of 5 with a probability of 0.00002.

Null text counts as empty; texts without words are duplicates only of equal texts. The class id is
the least doc_id in the class (null only if all are). Rows with equal doc_id and text are one
document given several times and get the same result. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import fingerprint, fresh, id_and_text, quoted, slices
from sessionlake.llm.graph import apart, components, grown
from sessionlake.llm.words import mix, runs, word_hashes
from sessionlake.session import keep

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 28, 5
#: Texts compared at once with as many others of their bucket.
BLOCK = 128
#: Signatures that agree in less than this share, five deviations below the threshold, are not verified.
SLACK = 5.0


def weighted_shingles(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, weight) of the distinct shingles, by text."""
    hashes, counts = word_hashes(values)
    found, made = runs(hashes, counts, SHINGLE)
    text = np.repeat(np.arange(len(made)), made)
    key = mix(found + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(first, kind="stable")
    first, times = first[order], times[order]
    return text[first], found[first], 1 + np.log(times)


_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """The winning shingle of each component, a row per text; texts without shingles have zeros."""
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    live, time, turn = np.arange(len(text)), np.zeros(len(text)), 0
    while live.size:
        many = 1 if live.size > 8192 or not turn else 16
        turns = np.arange(turn, turn + many, dtype=np.uint64)
        base = shingle[live][:, None] + turns * _STEP
        chance = ((mix(base) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        at = time[live][:, None] + np.cumsum(-np.log(chance), 1) / weight[live][:, None]
        place = ((mix(base ^ _TURN) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        cell = (text[live][:, None] * m + place).ravel()
        flat = at.ravel()
        soon = flat < first[cell]
        cell, flat, who = cell[soon], flat[soon], np.repeat(shingle[live], many)[soon]
        np.minimum.at(first, cell, flat)
        won = flat == first[cell]
        winner[cell[won]] = who[won]
        time[live] = at[:, -1]
        latest = first.reshape(n, m).max(1)
        live = live[at[:, -1] < latest[text[live]]]
        turn += many
    return winner.reshape(n, m)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, bands, sig) of every document, written once."""
    docs = id_and_text(docs)
    schema = T.StructType(
        [
            docs.schema["doc_id"], T.StructField("fp", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            prints = [hashlib.md5(t.as_buffer()).digest() for t in texts]
            order: dict[bytes, int] = {}
            where = np.array([order.setdefault(p, len(order)) for p in prints])
            once = texts.take(pa.array(np.unique(where, return_index=True)[1]))
            text, shingle, weight = weighted_shingles(once)
            n = len(once)
            won = signatures(text, shingle, weight, n, BANDS * ROWS)
            bands = np.zeros((n, BANDS), np.uint64)
            for row in range(ROWS):
                bands = mix(bands * _STEP + won[:, row::ROWS])
            bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * _TURN).view(np.int64)
            none = np.bincount(text, minlength=n) == 0
            small = (won & np.uint64(0xFFFF)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(prints, pa.binary()),
                    pa.array([None if none[k] else bands[k] for k in where], pa.list_(pa.int64())),
                    pa.array([small[k].tobytes() for k in where], pa.binary()),
                ],
                schema.names,
            )

    return keep(docs.mapInArrow(run, schema), "signed")


def agreeing(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) whose signatures agree in enough components."""
    least = needed(threshold)
    sig = lambda name: reps.select(F.col("fp").alias(name), F.col("sig").alias(f"sig_{name}"))
    joined = pairs.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = matrix(batch.column("sig_a")) == matrix(batch.column("sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array(same.sum(1) >= least))

    return joined.mapInArrow(run, "a binary, b binary")


def needed(threshold: float) -> int:
    m = BANDS * ROWS
    return int(np.floor(m * threshold - SLACK * np.sqrt(m * threshold * (1 - threshold))))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BANDS * ROWS)


Bag = tuple[np.ndarray, np.ndarray]


def similarity(a: Bag, b: Bag) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard of two (sorted shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(ia)
    if not len(ia):
        return 0.0, 0.0
    wa, wb = a[1][ia], b[1][ib]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    # For a shared shingle, one with a higher ratio counts by `a`, one with a lower by `b`.
    order = np.argsort(wa / wb, kind="stable")
    wa, wb = wa[order], wb[order]
    above = np.cumsum(wa[::-1])[::-1] + only_a
    below = np.cumsum(wb) - wb + only_b
    return float((1 / (above / wa + below / wb)).sum()), len(ia) / union


def with_texts(rows: DataFrame, docs: DataFrame, reps: DataFrame, *ends: str) -> DataFrame:
    """`rows` with the text of each of their fingerprint columns `ends` beside it as `text_…`."""
    texts = id_and_text(docs).select(fingerprint(F.col("text")).alias("own_fp"), F.col("doc_id").alias("own_id"), "text")
    named = reps.select("fp", F.col("rep.doc_id").alias("rep_id"))
    for end in ends:
        rows = rows.join(named.withColumnsRenamed({"fp": end, "rep_id": f"id_{end}"}), end)
    rows = keep(rows, "pairs")
    for end in ends:
        # One document stands for all of a text, so copies are not met again here.
        same = (F.col(end) == F.col("own_fp")) & F.col(f"id_{end}").eqNullSafe(F.col("own_id"))
        rows = rows.join(texts.withColumnRenamed("text", f"text_{end}"), same).drop("own_fp", "own_id", f"id_{end}")
    return rows


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) that are linked, judged on their texts."""
    both = with_texts(pairs, docs, reps, "b", "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_b"):
            sides = []
            for name in ("text_a", "text_b"):
                # A centre comes with many members in a row: its shingles are found once.
                codes = batch.column(name).dictionary_encode()
                text, shingle, weight = weighted_shingles(codes.dictionary)
                order = np.lexsort((shingle, text))
                cuts = np.searchsorted(text[order], np.arange(len(codes.dictionary) + 1))
                sides.append(
                    (codes.indices.to_pylist(), [
                        (shingle[order[low:high]], weight[order[low:high]])
                        for low, high in zip(cuts[:-1], cuts[1:], strict=True)
                    ])
                )
            (at_a, of_a), (at_b, of_b) = sides
            keeps = [max(similarity(of_a[x], of_b[y])) >= threshold - 1e-12 for x, y in zip(at_a, at_b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keeps, pa.bool_()))

    return keep(both.mapInArrow(run, "a binary, b binary"), "linked")


def bags(texts: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(fp, bag) for fingerprints `texts` (fp): 32-bit hashes of the shingles, sorted, and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_fp"):
            text, shingle, weight = weighted_shingles(batch.column("text_fp"))
            short = (shingle >> np.uint64(32)).astype("<u4")
            order = np.lexsort((short, text))
            text, short, weight = text[order], short[order], weight[order].astype("<f4")
            once = np.ones(len(text), bool)
            once[1:] = (text[1:] != text[:-1]) | (short[1:] != short[:-1])
            text, short, weight = text[once], short[once], weight[once]
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            found = [short[x:y].tobytes() + weight[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(found, pa.binary())], ["fp", "bag"])

    read = with_texts(texts, docs, reps, "fp").select("fp", "text_fp")
    return keep(read.mapInArrow(run, "fp binary, bag binary"), "bags")


def bag_of(raw: bytes) -> Bag:
    n = len(raw) // 8
    return np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<f4", n, 4 * n).astype(float)


#: What 32-bit hashes may be off by.
COARSE = 0.005


class Block:
    """Members of a bucket side by side."""

    def __init__(self, members: pa.StructArray) -> None:
        self.fp = members.field("fp").to_pylist()
        self.cls = np.array(members.field("cls").to_pylist(), object)
        self.sig = matrix(members.field("sig"))
        self.bands = members.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        self.bags = [bag_of(b) for b in members.field("bag").to_pylist()]

    def near(self, k: int, other: Block, key: int, least: int, threshold: float) -> list[int]:
        """Members of `other` to verify with member `k`: in another class, first met in this bucket,
        about `threshold` near or nearer. Of a class that surely is near, the nearest is enough."""
        bands = other.bands == self.bands[k]
        first = np.take_along_axis(other.bands, bands.argmax(1)[:, None], 1)[:, 0] == key
        close = (other.sig == self.sig[k]).sum(1) >= least
        likely = np.flatnonzero(close & first & (other.cls != self.cls[k]))
        found: dict[bytes, list[tuple[float, int]]] = {}
        for j in likely.tolist():
            how = max(similarity(self.bags[k], other.bags[j]))
            if how >= threshold - COARSE:
                found.setdefault(other.cls[j], []).append((how, j))
        best = {c: max(m) for c, m in found.items()}
        sure = threshold + COARSE
        return [j for c, m in found.items() for how, j in m if best[c][0] < sure or (how, j) == best[c]]


def crossing(buckets: DataFrame, classes: DataFrame, docs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one bucket in different classes to verify, as many as it takes to join classes.

    In each bucket the members of its largest class are not compared with each other; the others are
    compared with them and among themselves, in blocks, so that no bucket lands in one task whole.
    A pair is looked at in the first bucket that it shares, by signature and then by shingles."""
    own = buckets.join(classes, buckets["fp"] == classes["node"], "left").select(
        "key", "fp", F.coalesce("label", "fp").alias("cls")
    )
    sized = own.groupBy("key", "cls").count()
    opened = (
        sized.groupBy("key")
        .agg(
            F.max_by("cls", F.struct("count", "cls")).alias("main"), F.max("count").alias("mains"),
            F.sum("count").alias("all"),
        )
        .where(F.col("all") > F.col("mains"))
    )
    blocks = lambda n: F.pmod(F.xxhash64("fp"), F.ceil(n / BLOCK)).cast("int")
    minor = F.col("cls") != F.col("main")
    others = F.col("all") - F.col("mains")
    held = keep(
        own.join(opened, "key").select(
            "key", "fp", "cls", minor.alias("minor"),
            F.when(minor, blocks(others)).otherwise(blocks(F.col("mains"))).alias("block"),
        ),
        "open",
    )
    facts = reps.select("fp", "sig", "bands").join(bags(held.select("fp").distinct(), docs, reps), "fp")
    grouped = keep(
        held.join(facts, "fp")
        .groupBy("key", "minor", "block")
        .agg(F.collect_list(F.struct("fp", "cls", "sig", "bands", "bag")).alias("members")),
        "blocks",
    )
    left = grouped.where("minor").select("key", F.col("block").alias("left_block"), F.col("members").alias("one"))
    right = grouped.select("key", F.col("minor").alias("both"), "block", F.col("members").alias("two"))
    met = left.join(right, "key").where(~F.col("both") | (F.col("left_block") <= F.col("block")))
    least = needed(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, key in enumerate(batch.column("key").to_pylist()):
                one, two = Block(batch.column("one")[k].values), Block(batch.column("two")[k].values)
                pairs = [
                    sorted((one.fp[i], two.fp[j]))
                    for i in range(len(one.fp))
                    for j in one.near(i, two, key, least, threshold)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[side] for p in pairs], pa.binary()) for side in (0, 1)], ["a", "b"]
                )

    return keep(met.select("key", "one", "two").mapInArrow(run, "a binary, b binary").distinct(), "across")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, fp, class_id, kept) for every document; in each class the document with the least
    id is kept."""
    every = signed(docs)
    void = F.col("doc_id").isNull().alias("void")
    reps = keep(
        every.groupBy("fp").agg(
            F.min(F.struct(void, "doc_id")).alias("rep"), F.first(F.struct("bands", "sig")).alias("own")
        ).select("fp", "rep", "own.bands", "own.sig"),
        "texts",
    )
    members = reps.select("fp", F.explode("bands").alias("key"))
    centres = members.groupBy("key").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = keep(members.join(centres, "key").select("key", "fp", "a"), "buckets")
    stars = buckets.where(F.col("fp") != F.col("a"))
    # First one partner each, the least; most copies have found their class then. Next the other
    # partners, where classes still differ, and last whatever else a bucket holds apart.
    nearest = stars.groupBy(F.col("fp").alias("b")).agg(F.min("a").alias("a"))
    classes = components(verified(agreeing(nearest, reps, threshold), docs, reps, threshold))
    others = apart(stars.select("a", F.col("fp").alias("b")).distinct(), classes).select("a", "b")
    classes = grown(classes, verified(agreeing(others, reps, threshold), docs, reps, threshold))
    across = crossing(buckets.select("key", "fp"), classes, docs, reps, threshold)
    if across.limit(1).count():
        classes = grown(classes, verified(across, docs, reps, threshold))
    labelled = reps.select("fp", "rep").join(classes, reps["fp"] == classes["node"], "left").select(
        "fp", F.coalesce("label", "fp").alias("cls"), F.struct("rep.void", "rep.doc_id", "fp").alias("first")
    )
    heads = labelled.groupBy("cls").agg(F.min("first").alias("head"))
    heads = labelled.join(heads, "cls").select("fp", "head")
    return every.select("doc_id", "fp").join(heads, "fp").select(
        "doc_id", "fp", F.col("head.doc_id").alias("class_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("fp") == F.col("head.fp"))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with the columns it came with. A document given several times is
    returned once."""
    mark, own = fresh(docs, "fp"), docs.columns
    kept = near_duplicates(docs, threshold).where("kept").select(F.col("fp").alias("_kept"), F.col("doc_id").alias("_id"))
    marked = docs.withColumn(mark, fingerprint(F.col("text")))
    same = (marked[mark] == kept["_kept"]) & marked["doc_id"].eqNullSafe(kept["_id"])
    return marked.join(kept, same, "left_semi").dropDuplicates([mark, "doc_id"]).select(*map(quoted, own))
