"""Transcripts that grow, line by line: a streaming source with a position in every file.

An offset of the stream is the number of a round. A round lists the root, finds which files have grown
by whole lines since the round before, and notes the new stretch of each in a log: `log/<number>.json`,
a stretch a line. A stretch ends behind a line feed, found by reading the file backward from its end, so a line
still being written waits. Spark's checkpoint keeps the numbers, the log what they stand for, and a round
is never changed once written: a batch run again reads the same bytes. Every `SNAPSHOT` rounds all
positions are written beside, so that a start reads one of those and the rounds after it. A file
that is shorter than its position was written anew: its stretch begins at 0 and is marked.

What is read is the stretches and nothing else, long ones by several tasks, cut where lines begin.
Rows are (file, rewritten, block, seq, at, end, raw): the place of the line in bytes, its count in
its block, and the end of the whole stretch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SHAPE = "file STRING, rewritten BOOLEAN, block BIGINT, seq BIGINT, at BIGINT, `end` BIGINT, raw STRING"
NAMES = ["file", "rewritten", "block", "seq", "at", "end", "raw"]
#: Bytes of a stretch that one task reads, bytes read at once, rounds between two lists of all positions.
SPLIT, PIECE, SNAPSHOT = 64 << 20, 1 << 20, 64


def filesystem(path: str):
    """The file system of a path or address, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


@dataclass(frozen=True)
class Stretch:
    file: str
    begin: int
    end: int
    rewritten: bool = False


@dataclass
class Part(InputPartition):
    """The lines of a stretch that begin in [low, high)."""

    stretch: Stretch
    low: int
    high: int


def parts(stretch: Stretch, split: int | None = None) -> list[Part]:
    step = split or SPLIT
    lows = range(stretch.begin, stretch.end, step)
    return [Part(stretch, low, min(low + step, stretch.end)) for low in lows]


def lines_of(part: Part, files=None, path: str | None = None, tail: bool = False) -> Iterator[pa.RecordBatch]:
    """The lines of a part as they stand, bytes that are no text too. With `tail`, also a last one that has no
    line feed."""
    files = files or filesystem(part.stretch.file)[0]
    path = path or filesystem(part.stretch.file)[1]
    seq = 0
    with files.open_input_file(path) as source:
        at = part.low
        if at > part.stretch.begin:  # the line that is open here belongs to the part before
            at -= 1
            while True:
                source.seek(at)
                piece = source.read(min(PIECE, part.stretch.end - at))
                found = piece.find(b"\n")
                at += found + 1 if found >= 0 else len(piece)
                if found >= 0 or not piece or at >= part.high:
                    break
        pieces, read = [], at  # a line still open, and how far has been read
        source.seek(at)
        while at < part.high:
            piece = source.read(min(PIECE, part.stretch.end - read))
            if not piece:
                break
            read += len(piece)
            pieces.append(piece)
            if b"\n" not in piece:
                continue
            held = b"".join(pieces)
            last = held.rfind(b"\n")
            raw = np.frombuffer(held, np.uint8, last + 1)
            stops = np.flatnonzero(raw == 0x0A)
            begins = np.concatenate([[0], stops[:-1] + 1])
            n = int(np.searchsorted(begins, part.high - at))
            keep = np.ones(len(raw), bool)
            keep[stops] = False
            offsets = np.concatenate([[0], np.cumsum(stops[:n] - begins[:n])]).astype(np.int64)
            texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[keep].tobytes()))
            s = part.stretch
            columns = [
                pa.array([s.file] * n, pa.string()), pa.array([s.rewritten] * n, pa.bool_()),
                pa.array(np.full(n, part.low)), pa.array(np.arange(seq, seq + n)), pa.array(at + begins[:n]),
                pa.array(np.full(n, s.end)), texts.cast(pa.string(), safe=False),
            ]
            if n:
                yield pa.RecordBatch.from_arrays(columns, NAMES)
            seq, at = seq + n, at + last + 1
            if n < len(stops):
                return
            pieces = [held[last + 1 :]]
        rest = b"".join(pieces)
        if tail and rest and at < part.high:
            s = part.stretch
            row = [s.file], [s.rewritten], [part.low], [seq], [at], [s.end]
            text = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(rest)]).tobytes()), pa.py_buffer(rest))
            yield pa.RecordBatch.from_arrays([*map(pa.array, row), text.cast(pa.string(), safe=False)], NAMES)


def last_line_end(files, path: str, low: int, size: int) -> int:
    """Behind the last line feed in [low, size), or `low` where there is none."""
    with files.open_input_file(path) as source:
        high = size
        while high > low:
            begin = max(low, high - (1 << 16))
            source.seek(begin)
            found = source.read(high - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            high = begin
    return low


class Log:
    """The rounds, and the position of every file after the last of them."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = filesystem(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.number, self.positions = self._start()

    def _names(self) -> list[str]:
        from pyarrow import fs

        return [i.base_name for i in self.files.get_file_info(fs.FileSelector(self.folder))]

    def _read(self, name: str) -> list[Stretch]:
        with self.files.open_input_stream(f"{self.folder}/{name}") as held:
            return [Stretch(**json.loads(line)) for line in held.read().splitlines()]

    def _write(self, name: str, rows: list[Stretch]) -> None:
        aside = f"{self.folder}/.{name}"
        with self.files.open_output_stream(aside) as out:
            out.write("".join(json.dumps(asdict(r)) + "\n" for r in rows).encode())
        self.files.move(aside, f"{self.folder}/{name}")

    def _start(self) -> tuple[int, dict[str, int]]:
        names = self._names()
        rounds = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))
        whole = max((int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)-all\.json", n))), default=0)
        positions = {s.file: s.end for s in self._read(f"{whole:012d}-all.json")} if whole else {}
        for number in (r for r in rounds if r > whole):
            positions |= {s.file: s.end for s in self._read(f"{number:012d}.json")}
        return max([whole, *rounds], default=0), positions

    def add(self, rows: list[Stretch]) -> None:
        self.number += 1
        self._write(f"{self.number:012d}.json", rows)
        self.positions |= {s.file: s.end for s in rows}
        if self.number % SNAPSHOT == 0:
            self._write(f"{self.number:012d}-all.json", [Stretch(f, 0, e) for f, e in self.positions.items()])

    def between(self, after: int, upto: int) -> list[Stretch]:
        """The stretches of some rounds, those of one file that follow each other as one."""
        joined: dict[str, Stretch] = {}
        for number in range(after + 1, upto + 1):
            for s in self._read(f"{number:012d}.json"):
                held = joined.get(s.file)
                joined[s.file] = replace(held, end=s.end) if held and s.begin == held.end else s
        return list(joined.values())


def grown(root: str, positions: dict[str, int], suffix: str = ".jsonl") -> list[Stretch]:
    """What has been written under a root behind the positions."""
    from pyarrow import fs

    files, top = filesystem(root)
    found = files.get_file_info(fs.FileSelector(top, recursive=True))
    due = [i for i in found if i.is_file and i.path.endswith(suffix) and i.size != positions.get(i.path, 0)]

    def stretch(i) -> Stretch:
        at = positions.get(i.path, 0)
        rewritten = i.size < at
        low = 0 if rewritten else at
        return Stretch(i.path, low, last_line_end(files, i.path, low, i.size), rewritten)

    with ThreadPoolExecutor(16) as pool:
        return [s for s in pool.map(stretch, due) if s.end > s.begin or s.rewritten]


class LineReader(DataSourceStreamReader):
    def __init__(self, root: str, log: str) -> None:
        self.root, self.folder = root, log
        self.log: Log | None = None

    def _log(self) -> Log:
        self.log = self.log or Log(self.folder)
        return self.log

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        log = self._log()
        new = grown(self.root, log.positions)
        if new:
            log.add(sorted(new, key=lambda s: s.file))
        return {"round": log.number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = [p for s in self._log().between(start["round"], end["round"]) for p in parts(s)]
        return found or [Part(Stretch("", 0, 0), 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.stretch.file:
            yield from lines_of(partition)

    def commit(self, end: dict) -> None:
        """The log stays: a batch may be run again from an older checkpoint."""

    def stop(self) -> None:
        self.log = None


class LineSource(DataSource):
    """`readStream.format("session_lines").option("path", root).option("log", folder)`."""

    @classmethod
    def name(cls) -> str:
        return "session_lines"

    def schema(self) -> str:
        return SHAPE

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options["path"], self.options["log"])


def line_stream(spark: SparkSession, root: str, log: str) -> DataFrame:
    """New lines of all transcripts under a root, as they are written."""
    spark.dataSource.register(LineSource)
    return spark.readStream.format("session_lines").option("path", root).option("log", log).load()


def lines_upto(ends: DataFrame) -> DataFrame:
    """The whole lines of files from their first byte up to an `end`: (file, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from lines_of(Part(Stretch(row["file"], 0, row["end"]), row["low"], row["high"]))

    step = F.lit(SPLIT)
    lows = F.explode(F.sequence(F.lit(0), F.greatest(F.col("end") - 1, F.lit(0)), step)).alias("low")
    cut = ends.filter("end > 0").select("file", "end", lows).withColumn("high", F.least(F.col("low") + step, F.col("end")))
    return cut.repartition("file", "low").mapInArrow(run, SHAPE)


def numbered(lines: DataFrame) -> DataFrame:
    """`lines` with their place in their file's stretch, from 1."""
    from pyspark.sql.window import Window

    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1
    starts = blocks.select("file", "block", base.alias("base"))
    return lines.join(starts, ["file", "block"]).withColumn("place", F.col("base") + F.col("seq")).drop("base")
