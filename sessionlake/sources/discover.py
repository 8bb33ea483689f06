"""Recorded sessions on disk: which files there are, what each is, and their lines in order."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlake.functions.jsons import read_json
from sessionlake.ingest.lines import reject
from sessionlake.ingest.records import META
from sessionlake.schema import MAIN
from sessionlake.session import keep
from sessionlake.sources.folders import contents, file_lines, plain, split_bytes, tree

RECENT_DAYS = 7


def classified(files: DataFrame, root: str) -> DataFrame:
    """Each file with its project folder, session, and what reads it.

    Every column is one pattern over the path, so none is built out of another.
    """
    top = "^" + re.escape(plain(root)) + "/([^/]+)/([^/]+?)"
    below = top + "/subagents/(?:workflows/(wf_[^/]+)/)?"
    agent, meta = below + r"agent-([^/]+?)\.jsonl$", below + r"agent-([^/]+?)\.meta\.json$"
    journal = top + r"/subagents/workflows/(wf_[^/]+)/journal\.jsonl$"
    file = F.col("file")
    role = (
        F.when(file.rlike(top + r"\.jsonl$"), "main")
        .when(file.rlike(meta), "meta")
        .when(file.rlike(agent), "agent")
        .when(file.rlike(journal), "journal")
        .when(file.rlike(top + "/tool-results/[^/]+$"), "offload")
        .when(file.rlike(top + r"/(workflows/.*|custom-title\.json|auto-mode-classifier-error\.txt)$"),
              "ignored")
        .otherwise("unknown")
    )

    def found(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(file, pattern, group), F.lit(""))

    either = below + r"agent-([^/]+?)(?:\.meta\.json|\.jsonl)$"
    return files.select(
        "*",
        found(top + r"(?:\.jsonl$|/)", 1).alias("project_folder"),
        found(top + r"(?:\.jsonl$|/)", 2).alias("session_id"), role.alias("role"),
        F.when(file.rlike(top + r"\.jsonl$"), F.lit(MAIN)).otherwise(
            F.coalesce(found(either, 4), F.concat(found(journal, 3), F.lit("/journal")))
        ).alias("source"),
        F.coalesce(found(either, 3), found(journal, 3)).alias("workflow_id"),
        F.element_at(F.split(file, "/", -1), -1).alias("name"),
    )


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Every file under a root with size and time; no content is read, and no list of files reaches the driver."""
    files = tree(spark, root).select("file", F.timestamp_millis("modified").alias("modificationTime"), "length")
    return classified(files, root)


def projects(files: DataFrame, now: str, recent_days: int = RECENT_DAYS) -> DataFrame:
    """Project folders holding a transcript, with how many sessions and how many recent ones."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {recent_days} DAYS")
    return (
        files.filter(F.col("role") == "main")
        .groupBy("project_folder")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.count_if(F.col("modificationTime") >= since).alias("recent_sessions"),
        )
        .orderBy(F.col("recent_sessions").desc(), F.col("sessions").desc(), "project_folder")
    )


def layout_errors(files: DataFrame) -> DataFrame:
    """Files nothing can place, and agent transcripts or descriptions missing their other half."""
    unknown = reject(files.filter(F.col("role") == "unknown"), "unknown file", F.col("name"))
    halves = (
        files.filter(F.col("role").isin("agent", "meta"))
        .groupBy("session_id", "source")
        .agg(F.min("role").alias("lo"), F.max("role").alias("hi"))
        .filter(F.col("lo") == F.col("hi"))
    )
    return unknown.unionByName(reject(halves, "transcript or description alone", F.col("source")))


def fingerprints(files: DataFrame, extractor_version: str) -> DataFrame:
    """One digest per session over every file it holds: name, size, time, and the reader's version."""
    entry = F.concat_ws(
        "\u0000", F.col("file"), F.col("length").cast("string"),
        F.unix_micros("modificationTime").cast("string"),
    )
    # Sums that do not depend on order, so no session's files are gathered anywhere.
    mark = F.xxhash64(entry)
    again = F.xxhash64(F.lit("again"), entry)
    state = F.concat_ws(
        " ", F.lit(extractor_version), F.count(F.lit(1)), F.bit_xor(mark), F.bit_xor(again),
        F.sum(mark.cast("decimal(38,0)")),
    )
    return files.groupBy("session_id").agg(
        F.sha2(state, 256).alias("fingerprint"),
        F.max(F.when(F.col("role") == "main", F.col("file"))).alias("transcript_path"),
        F.max("project_folder").alias("project_folder"),
    )


#: Paths in one condition, and in all of them: beyond, whole folders are read and joined with the paths.
PATHS_AT_ONCE, MOST_PATHS = 5_000, 100_000


def _decoded(path: Column) -> Column:
    """A file URL as a plain path."""
    plainer = F.regexp_replace(path, r"^file:/+", "/")
    return F.url_decode(F.regexp_replace(plainer, r"\+", "%2B"))


def _address(file: str) -> str:
    """A path as Spark's own readers have it in `_metadata.file_path`: what no URL may hold is written by its bytes."""
    odd = r"[\x00-\x20\x7f-\xa0\"#%<>?\[\\\]^`{|}\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    told = re.sub(odd, lambda m: quote(m[0], safe=""), file)
    return f"file:{told}" if file.startswith("/") else told


def only(read: DataFrame, files: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns of what one of Spark's own readers would read, of just `files`. Their addresses are conditions on the
    files' own data, so Spark leaves the others unopened. They reach the driver, as does the reader's own listing:
    for roots of a size a driver holds. A refresh reads by `file_lines` and `contents`."""
    path = "_metadata.file_path"
    told = files.select("file").distinct()
    addresses = [_address(r[0]) for r in told.limit(MOST_PATHS + 1).collect()]
    if len(addresses) > MOST_PATHS:
        told = told.withColumnRenamed("file", "_file")
        found = read.select(_decoded(F.col(path)).alias("_file"), *columns)
        return found.join(told, "_file", "left_semi").drop("_file")
    runs = [addresses[k : k + PATHS_AT_ONCE] for k in range(0, len(addresses), PATHS_AT_ONCE)] or [[]]
    return reduce(DataFrame.unionByName, [read.filter(F.col(path).isin(run)).select(*columns) for run in runs])


def numbered_lines(
    spark: SparkSession, root: str, pattern: str = "*.jsonl", files: DataFrame | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(file, line_no, raw): every line with its number in its file, large files read in pieces.

    A file is split at newlines only and read by as many tasks as it has pieces. Lines are numbered within their
    piece as they are read; pieces then learn how many lines came before. With `files`, only those are opened,
    and their columns `carry` come with each line.
    """
    files = listing(spark, root) if files is None else files
    files = files.filter(F.regexp_like(F.element_at(F.split("file", "/"), -1), F.lit(fnmatch.translate(pattern))))
    read = keep(file_lines(spark, root, files, carry), "lines")
    # Few files have more than one piece: a row for each later piece meets the lines.
    cut = read.filter(F.col("end") > split_bytes(spark)).groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(cut.select("file", "block", F.sum("n").over(before).alias("before")).filter("before > 0"), "starts")
    line_no = (F.coalesce("before", F.lit(0)) + F.col("seq") + 1).cast("int")
    mark = (line_no == 1) & F.col("raw").startswith("\ufeff")
    return read.join(starts, ["file", "block"], "left").select(
        "file", *carry, line_no.alias("line_no"),
        F.when(mark, F.col("raw").substr(F.lit(2), F.length("raw"))).otherwise(F.col("raw")).alias("raw"),
    )


@dataclass
class Recorded:
    files: DataFrame
    lines: DataFrame
    metas: DataFrame
    offloads: DataFrame
    paths: DataFrame


def recorded(
    spark: SparkSession, root: str, sessions: DataFrame | None = None, files: DataFrame | None = None
) -> Recorded:
    """Everything recorded under a root, or of the sessions named. `files`: the root's listing, where the caller
    has it."""
    files = keep(listing(spark, root), "listing") if files is None else files
    if sessions is not None:
        files = keep(files.join(sessions.select("session_id"), "session_id", "left_semi"), "files")
    told = files.filter(F.col("role").isin("main", "agent", "journal"))
    lines = numbered_lines(spark, root, files=told, carry=("session_id", "source")).drop("file")
    return Recorded(files, lines, metas(spark, root, files), offload_files(spark, root, files), paths(files))


def metas(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """What is written beside each agent transcript."""
    found = files.filter(F.col("role") == "meta").select(
        "file", "length", "session_id", F.col("source").alias("agent_id"), "workflow_id"
    )
    told = contents(root, found).withColumn("m", read_json(F.col("content").cast("string"), META))
    return keep(told.select("session_id", "agent_id", "workflow_id", "m.*"), "metas")


def paths(files: DataFrame) -> DataFrame:
    return files.filter(F.col("role") == "main").select(
        "session_id", F.col("file").alias("transcript_path")
    )


def offload_files(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Tool output kept beside a transcript, as text; bytes that are none are replaced and said so."""
    found = files.filter(F.col("role") == "offload").select("file", "length", "session_id", "name")
    text = F.col("content").cast("string")
    return contents(root, found).select(
        "session_id", "name", F.make_valid_utf8(text).alias("content"),
        (~F.is_valid_utf8(text)).alias("lossy_decode"), F.col("length").alias("size_bytes"),
    )
