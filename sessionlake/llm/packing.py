"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A document is cut into pieces of `limit` ids; only its last piece can be shorter, and only those
last pieces need packing. Documents are dealt into blocks of bounded size by row number, so that no
id, source or group of copies meets in one task. Each block is one packing problem. Several islands
breed solutions of it apart: a child takes whole well-filled bins of one parent, drops the bins of
the other that share a document with them, and puts the documents so displaced where they fit
tightest. Between rounds every island sends its best solutions to the next one. A block stops when
it needs no more bins than its ids fill.

Null and empty texts are documents of just the end id. Rows repeated, whatever their ids, are packed
each for itself. Only `doc_id` and `text` are read, so other columns cannot clash. No rows in, no
rows out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import id_and_text, slices, task_number
from sessionlake.llm.tokens import encoder, vocabulary
from sessionlake.session import keep


@dataclass(frozen=True)
class Breeding:
    """How much search a block gets. Nothing here bounds how many documents are packed."""

    block: int = 8192
    islands: int = 3
    rounds: int = 2
    population: int = 6
    generations: int = 6
    migrants: int = 2
    seed: int = 11


class Room:
    """Bins by the room left in them; finds the tightest that takes a size."""

    def __init__(self, room: np.ndarray) -> None:
        self.bins: dict[int, list[int]] = {}
        self.mask = 0
        for number, left in enumerate(room.tolist()):
            self.put(number, left)

    def put(self, number: int, left: int) -> None:
        if left > 0:
            self.bins.setdefault(left, []).append(number)
            self.mask |= 1 << left

    def take(self, size: int) -> tuple[int, int] | None:
        fits = self.mask >> size
        if not fits:
            return None
        left = size + (fits & -fits).bit_length() - 1
        stack = self.bins[left]
        number = stack.pop()
        if not stack:
            self.mask &= ~(1 << left)
        return number, left - size


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, loads: np.ndarray, limit: int) -> int:
    """Puts the items of `order` one by one into `bins`; `loads` are the bins there are. Returns how
    many there are in the end."""
    room, count = Room(limit - loads), len(loads)
    for item in order.tolist():
        size = int(sizes[item])
        found = room.take(size)
        if found is None:
            found = count, limit - size
            count += 1
        bins[item] = found[0]
        room.put(*found)
    return count


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def worth(sizes: np.ndarray, bins: np.ndarray, limit: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones, as almost empty bins are nearest to going."""
    loads = np.bincount(bins, sizes)
    return -len(loads), float(np.square(loads / limit).sum())


def child(
    sizes: np.ndarray, one: np.ndarray, other: np.ndarray, limit: int, rng: np.random.Generator
) -> np.ndarray:
    """Well-filled bins of `other` injected into `one`."""
    loads = np.bincount(other, sizes)
    full = np.argsort(-loads, kind="stable")[: max(1, len(loads) // 2)]
    chosen = np.zeros(len(loads), bool)
    chosen[full[rng.random(len(full)) < rng.uniform(0.05, 0.4)]] = True
    injected = chosen[other]
    touched = np.zeros(int(one.max()) + 1, bool)
    touched[one[injected]] = True
    # One of the emptiest bins goes too, else a child could only copy bins.
    left = np.bincount(one, sizes)
    touched[np.argsort(left, kind="stable")[: 1 + int(rng.integers(3))]] = True
    loose = touched[one] & ~injected
    made = np.where(injected, other + len(touched), one).astype(np.int64)
    stay = ~loose
    made[stay] = compact(made[stay])
    kept = np.bincount(made[stay], sizes[stay]) if stay.any() else np.zeros(0)
    out = np.flatnonzero(loose)
    best_fit(sizes, out[np.argsort(-sizes[out], kind="stable")], made, kept.astype(np.int64), limit)
    return made.astype(np.int32)


def evolve(
    sizes: np.ndarray, crowd: list[np.ndarray], limit: int, breeding: Breeding, rng: np.random.Generator
) -> list[np.ndarray]:
    """A round of one island; the best come first."""
    fewest = -(-int(sizes.sum()) // limit)
    if not crowd:
        for k in range(breeding.population):
            keys = sizes * (1 + rng.normal(0, 0.02 * k, len(sizes))) if k else sizes
            bins = np.zeros(len(sizes), np.int64)
            best_fit(sizes, np.argsort(-keys, kind="stable"), bins, np.zeros(0, np.int64), limit)
            crowd.append(bins.astype(np.int32))
            if bins.max(initial=-1) + 1 <= fewest:
                break
    ranked = sorted(((worth(sizes, b, limit), b) for b in crowd), key=lambda p: p[0], reverse=True)
    ranked = ranked[: breeding.population]
    for _ in range(breeding.generations):
        if -ranked[0][0][0] <= fewest:
            break
        young = []
        for _ in range(breeding.population):
            a, b = (int(rng.integers(len(ranked), size=2).min()), int(rng.integers(len(ranked))))
            born = child(sizes, ranked[a][1], ranked[b][1], limit, rng)
            young.append((worth(sizes, born, limit), born))
        ranked = sorted(ranked + young, key=lambda p: p[0], reverse=True)[: breeding.population]
    return [b for _, b in ranked]


def encoded(docs: DataFrame, path: str, end: int, limit: int) -> DataFrame:
    """Per document: its row number, id, count of ids with the end id, and the checksum of each
    piece. Written once, as later steps refer to rows by number."""
    docs = id_and_text(docs)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", kind),
            T.StructField("n", T.LongType()),
            T.StructField("crcs", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, tool = task_number() << 33, encoder(path, False)
        for batch in slices(batches):
            ids, counts = tool.encode(batch.column("text"), end)
            ends = np.cumsum(counts)
            crcs = [
                [zlib.crc32(ids[k : min(k + limit, high)].tobytes()) for k in range(low, high, limit)]
                for low, high in zip((ends - counts).tolist(), ends.tolist(), strict=True)
            ]
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.list_(pa.int64()))],
                ["row", "doc_id", "n", "crcs"],
            )

    return keep(docs.mapInArrow(run, schema), "encoded")


POPULATION = "block long, island int, sizes array<int>, crowd array<array<int>>"


def bred(blocks: DataFrame, limit: int, breeding: Breeding) -> DataFrame:
    """(block, sizes) to (block, bins) of the best solution that any island found."""

    def a_round(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    sizes = np.array(row["sizes"], np.int64)
                    rng = np.random.default_rng([breeding.seed, row["block"], row["island"], number])
                    crowd = [np.array(b, np.int32) for b in row["crowd"]]
                    crowd = evolve(sizes, crowd, limit, breeding, rng)
                    yield pa.RecordBatch.from_pylist(
                        [row | {"crowd": [b.tolist() for b in crowd]}],
                        pa.schema(
                            {
                                "block": pa.int64(), "island": pa.int32(), "sizes": pa.list_(pa.int32()),
                                "crowd": pa.list_(pa.list_(pa.int32())),
                            }
                        ),
                    )

        return run

    islands = F.explode(F.sequence(F.lit(0), F.lit(breeding.islands - 1))).alias("island")
    none = F.array().cast("array<array<int>>").alias("crowd")
    state = blocks.select("block", islands, "sizes", none).repartition("block", "island")
    for number in range(breeding.rounds):
        state = keep(state.mapInArrow(a_round(number), POPULATION), "islands")
        if number + 1 < breeding.rounds and breeding.islands > 1:
            sent = state.select(
                "block",
                ((F.col("island") + 1) % breeding.islands).cast("int").alias("island"),
                F.lit(None).cast("array<int>").alias("sizes"),
                F.slice("crowd", 1, breeding.migrants).alias("crowd"),
            )
            state = (
                state.unionByName(sent)
                .groupBy("block", "island")
                .agg(
                    F.max("sizes").alias("sizes"),
                    F.flatten(F.sort_array(F.collect_list("crowd"))).alias("crowd"),
                )
            )
    best = F.col("crowd")[0]
    return state.groupBy("block").agg(
        F.min_by(best, F.struct(F.array_max(best), F.col("island"))).alias("bins")
    )


PIECE = (
    ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
    ("ids_crc32", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()),
)


def pack(
    docs: DataFrame,
    path: str | None = None,
    end: int = 1,
    limit: int = 4096,
    breeding: Breeding = Breeding(),
) -> DataFrame:
    """One row per piece of every document: its place in the document, its checksum, the sequence it
    is in and its offset there."""
    docs = encoded(docs, path or vocabulary("word_bpe_49k.json"), end, limit)
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    count = docs.count()
    block = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-count // breeding.block)))).alias("block")
    held = keep(
        docs.select(block, F.struct("row", "doc_id", "n", "crcs").alias("doc"))
        .groupBy("block")
        .agg(F.sort_array(F.collect_list("doc")).alias("docs")),
        "blocks",
    )
    sizes = F.filter(F.transform("docs", lambda d: (d["n"] % limit).cast("int")), lambda n: n > 0)
    placed = bred(held.select("block", sizes.alias("sizes")).where(F.size("sizes") > 0), limit, breeding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _placed(batch.slice(k, 1), limit)

    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(*f) for f in PIECE)])
    return (
        spark.createDataFrame([], schema)
        if not count
        else held.join(placed, "block", "left").mapInArrow(run, schema)
    )


def _placed(row: pa.RecordBatch, limit: int) -> pa.RecordBatch:
    """The pieces of one block, in its documents' order."""
    docs = row.column("docs").flatten()
    block = row.column("block")[0].as_py()
    n = docs.field("n").to_numpy(zero_copy_only=False)
    crcs = docs.field("crcs").flatten().to_numpy(zero_copy_only=False)
    whole, rest = n // limit, n % limit
    pieces = whole + (rest > 0)
    doc = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    short = piece == whole[doc]
    bins = row.column("bins")[0].as_py()
    bins = np.array(bins if bins is not None else [], np.int64)
    sizes = rest[rest > 0]
    order = np.argsort(bins, kind="stable")
    sums = np.cumsum(sizes[order]) - sizes[order]
    heads = np.flatnonzero(np.diff(bins[order], prepend=-1))
    counts = np.diff(heads, append=len(order))
    offsets = np.zeros(len(order), np.int64)
    offsets[order] = sums - np.repeat(sums[heads], counts)
    sequence = np.zeros(len(doc), np.int64)
    offset = np.zeros(len(doc), np.int64)
    sequence[short], offset[short] = bins, offsets
    sequence[~short] = bins.max(initial=-1) + 1 + np.arange(int((~short).sum()))
    return pa.RecordBatch.from_arrays(
        [
            docs.field("doc_id").take(pa.array(doc)),
            pa.array(piece.astype(np.int32)),
            pa.array(piece * limit),
            pa.array(np.where(short, rest[doc], limit)),
            pa.array(crcs),
            pa.array((block << 32) + sequence),
            pa.array(offset),
        ],
        ["doc_id", *(name for name, _ in PIECE)],
    )
