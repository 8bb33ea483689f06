"""The conversations' transcripts as files on disk, refreshed into an archive and read back.

Files stand as a recorder leaves them: a folder per project, a transcript per session, agent transcripts
with their descriptions beside, offloaded output. Some sessions have a damaged line, some a last line that
was cut off, some a record of a kind or with a field that nobody declared.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adapters.conversations import transcript_lines
from sessionlake.schema import MAIN
from sessionlake.session import keep, shared_folder
from sessionlake.sources.discover import listing
from sessionlake.sources.store import Refresh, Store, refresh
from sessionlake.sources.tail import filesystem


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(path below the root, line_no, raw): every line of every file."""
    lines = transcript_lines(spark, folder).withColumn("c", F.substring("session_id", 2, 18).cast("long"))
    c = F.col("c")
    main = F.col("source") == MAIN
    home = F.concat(F.lit("-p-"), c % 3, F.lit("/"), "session_id")
    agent = F.concat(home, F.lit("/subagents/agent-"), "source")
    path = F.when(main, F.concat(home, F.lit(".jsonl"))).otherwise(F.concat(agent, F.lit(".jsonl")))
    told = lines.select(path.alias("path"), "line_no", "raw")

    def added(no: int, raw: str, where) -> DataFrame:
        some = lines.filter(main & where).select(path.alias("path")).distinct()
        return some.select("path", F.lit(no).alias("line_no"), F.lit(raw).alias("raw"))

    metas = lines.filter(~main).select("session_id", "source", "c").distinct().select(
        F.concat(agent, F.lit(".meta.json")).alias("path"), F.lit(1).alias("line_no"),
        F.to_json(
            F.struct(
                F.lit("helper").alias("agentType"), F.concat(F.lit("brief "), c).alias("description"),
                F.concat(F.lit("toolu_"), c, F.lit("x1")).alias("toolUseId"), F.lit(1).alias("spawnDepth"),
                (c % 10 == 9).alias("isFork"),
            )
        ).alias("raw"),
    )
    outputs = lines.filter(main & (c % 4 == 2)).select("session_id", "c").distinct().select(
        F.concat(home, F.lit("/tool-results/out "), c, F.lit("%.txt")).alias("path"), F.lit(1).alias("line_no"),
        F.concat(F.lit("printed é "), c).alias("raw"),
    )
    odd_kind = added(10, json.dumps({"type": "mystery", "odd": 1}), c % 6 == 1)
    odd_field = added(10, json.dumps({"type": "system", "subtype": "informational", "weird": 1}), c % 6 == 2)
    damaged = added(9, "{not json", c % 7 == 3)
    cut = added(1_000_000, '{"type":"user","cut', c % 7 == 5)
    parts = [told, metas, outputs, odd_kind, odd_field, damaged, cut]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def write_recordings(spark: SparkSession, folder: str, root: str) -> None:
    """Lines go to their files in order, a blank line for each number left out; a file is written by one
    task, line after line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = filesystem(root)
        path, out, at = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if out:
                        out.close()
                    path, at = row["path"], 0
                    files.create_dir(f"{top}/{path}".rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(f"{top}/{path}")
                cut = row["line_no"] == 1_000_000
                gap = 0 if cut else row["line_no"] - at - 1
                out.write(b"\n" * gap + row["raw"].encode() + (b"" if cut else b"\n"))
                at = row["line_no"]
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([], pa.string())})

    lines = _files(spark, folder).repartition("path").sortWithinPartitions("path", "line_no")
    lines.mapInArrow(run, "path string").count()


@dataclass
class Recordings:
    root: str
    store: Store
    first: Refresh
    again: Refresh

    @cached_property
    def files(self) -> DataFrame:
        """What stands on disk now; listed when it is asked for."""
        return listing(self.store.spark, self.root)


@lru_cache(maxsize=4)
def recordings(spark: SparkSession, folder: str) -> Recordings:
    """The files, an archive refreshed from them twice, and what both refreshes said."""
    base = f"{shared_folder(spark).rstrip('/')}/recordings-{uuid.uuid4().hex}"
    write_recordings(spark, folder, f"{base}/projects")
    store = Store(spark, f"{base}/archive", buckets=16)
    first = refresh(store, f"{base}/projects", {"batch": "first"})
    first.status = keep(first.status, "first_status")
    again = refresh(store, f"{base}/projects")
    again.status = keep(again.status, "again_status")
    return Recordings(f"{base}/projects", store, first, again)
