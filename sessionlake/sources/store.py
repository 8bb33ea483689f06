"""The archive: relations in session buckets, written in layers, refreshed by fingerprint."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake import schema
from sessionlake.ingest.pipeline import extract
from sessionlake.ingest.unknown import unknown_fields, unknown_kinds
from sessionlake.operators.quality import shape_differences
from sessionlake.operators.relations import Tables
from sessionlake.session import keep
from sessionlake.sources import upkeep
from sessionlake.sources.commits import check_atomic, create, file_system
from sessionlake.sources.discover import (
    Recorded,
    classified,
    fingerprints,
    layout_errors,
    listing,
    metas,
    offload_files,
    paths,
    recorded,
)
from sessionlake.sources.tail import lines_upto, numbered

BUCKETS = 4096
#: Layers of like size that are merged into one.
FAN = 4
EXTRACTOR = "transcripts"
EXTRACTOR_VERSION = "1"
SCHEMA_VERSION = 11
#: The folders of a relation are named by this; no relation has a column of the name.
WRITE = "write_id"
#: Beside the relations: the sessions that each version replaces.
REPLACED = "_replaced"
REPLACED_SHAPE = T.StructType([T.StructField("session_id", T.StringType())])


def bucket_of(session: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


class Busy(RuntimeError):
    """Other writers committed first, as often as was tried."""


class Store:
    """Relations under one root, written as layers that are merged when they are read.

    A write adds a version that holds just the rows of the sessions it replaces, and a list of those
    sessions; nothing that was there is written again. A row counts unless a later version of its relation
    replaces its session. So that few versions stand at any time, versions of like size are merged
    after a write: a row is written again as often as the logarithm of the writes, and as few
    versions stand.

    A manifest is one file, named by its number and the schema version its rows are in, with a line for
    each relation and version in order. It is written aside and then renamed into place, which fails
    where its number is taken: of two writers that began from the same state one commits and the other
    names its version after it, without writing its rows again. Readers see the old manifest or the new
    one, never half a write; what a merge replaces stays on disk for those who still read it.
    """

    def __init__(
        self, spark: SparkSession, root: str, buckets: int = BUCKETS, one_writer: bool = False, kept_up: bool = False
    ) -> None:
        """`one_writer`: the caller sees to it that nobody else writes, so any file system will do.
        `kept_up`: every write also brings first holders and counts of sessions up to date, so that
        reports need not look for copies; to be said by all who write, from the first write on."""
        self.spark, self.root, self.buckets, self.kept_up = spark, root.rstrip("/"), buckets, kept_up
        check_atomic(spark, self.root, one_writer)

    def _files(self):
        return file_system(self.spark, f"{self.root}/manifests")

    def _last(self) -> tuple[int, int, str] | None:
        """(number, schema version, file) of the newest manifest."""
        path, files = self._files()
        if not files.exists(path):
            return None
        names = [f.getPath().getName() for f in files.listStatus(path)]
        found = [(int(m[1]), int(m[2]), n) for n in names if (m := re.fullmatch(r"(\d+)-v(\d+)\.csv", n))]
        if not found:
            return None
        number, version, name = max(found)
        if version > SCHEMA_VERSION:
            raise ValueError(f"store version {version} is newer than {SCHEMA_VERSION}")
        return number, version, f"{self.root}/manifests/{name}"

    def manifest(self, last: tuple[int, int, str] | None = None) -> DataFrame | None:
        """(relation, layer, version, bytes) as the last finished write left it."""
        last = last or self._last()
        if last is None:
            return None
        return self.spark.read.schema("relation STRING, layer INT, version STRING, bytes BIGINT").csv(last[2])

    def _layers(self, last: tuple[int, int, str] | None) -> dict[str, list[tuple[str, int]]]:
        """Each relation's (version, bytes), oldest first: as few as the logarithm of the writes."""
        found: dict[str, list] = {}
        for r in [] if last is None else sorted(self.manifest(last).collect(), key=lambda r: r.layer):
            found.setdefault(r.relation, []).append((r.version, r.bytes))
        return found

    def _folders(self, name: str, versions: list[str], shape: T.StructType | None) -> DataFrame:
        base = f"{self.root}/tables/{name}"
        reader = self.spark.read.option("basePath", base)
        if shape is None:
            reader = reader.option("mergeSchema", "true")
        else:
            place = [T.StructField(WRITE, T.StringType()), T.StructField("bucket", T.IntegerType())]
            reader = reader.schema(T.StructType([*shape.fields, *place]))
        return reader.parquet(*[f"{base}/{WRITE}={v}" for v in versions])

    def _live(self, name: str, versions: list[str], shape: T.StructType | None, buckets: list[int] | None) -> DataFrame:
        """The rows of some layers that no later one of them replaces, with their bucket."""

        def opened(df: DataFrame) -> DataFrame:
            return df if buckets is None else df.filter(F.col("bucket").isin(buckets))

        rows = opened(self._folders(name, versions, shape))
        if len(versions) == 1:
            return rows.drop(WRITE)
        layer = in_order(versions)
        replaced = self._folders(REPLACED, versions[1:], REPLACED_SHAPE)
        if schema.bucket_column(name) == schema.session_column(name):
            replaced = opened(replaced)
        newest = replaced.groupBy("session_id").agg(F.max(layer).alias("_newest"))
        column = schema.session_column(name)
        held = rows.withColumn("_layer", layer).join(newest.withColumnRenamed("session_id", column), column, "left")
        return held.filter(F.col("_newest").isNull() | (F.col("_layer") >= F.col("_newest"))).drop("_newest", "_layer", WRITE)

    def _placed(self, name: str, last: tuple[int, int, str] | None, buckets: list[int] | None) -> DataFrame:
        """A relation's rows with their bucket; only the folders of `buckets` are opened."""
        shape = schema.ALL_TABLES[name]
        versions = [v for v, _ in self._layers(last).get(name, [])]
        if not versions:
            return self.spark.createDataFrame([], T.StructType([*shape.fields, T.StructField("bucket", T.IntegerType())]))
        return self._live(name, versions, shape if last[1] == SCHEMA_VERSION else None, buckets)

    def _current(self, name: str, last: tuple[int, int, str] | None, buckets: list[int] | None = None) -> DataFrame:
        """As `_placed`, in today's columns also where the store is of an older version."""
        rows = self._placed(name, last, buckets)
        if last is None or last[1] == SCHEMA_VERSION:
            return rows
        runs = None
        if name == "compactions":
            runs = migrated(self._placed("agent_runs", last, buckets).drop("bucket"), "agent_runs", last[1])
        return migrated(rows.drop("bucket"), name, last[1], runs).withColumn("bucket", self._bucket(name))

    def _bucket(self, name: str) -> Column:
        return bucket_of(F.col(schema.bucket_column(name)), self.buckets)

    def _buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of a frame's first column: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.select(bucket_of(F.col(keys.columns[0]), self.buckets)).distinct().collect())

    def holders(self, ids: DataFrame) -> DataFrame:
        """Who holds each of `ids` (id, relation): just their buckets are opened."""
        ids = ids.select("id", "relation").distinct()
        rows = self._current("id_holders", self._last(), self._buckets_of(ids))
        return rows.join(ids, ["id", "relation"], "left_semi").select(*schema.DERIVED["id_holders"].names)

    def table(self, name: str, sessions: list[str] | DataFrame | None = None) -> DataFrame:
        """A relation as it stands. Of `sessions` only, where given: just their buckets are opened, and
        of a list, in them just their row groups."""
        last, column = self._last(), schema.session_column(name)
        if sessions is None:
            rows = self._current(name, last)
        elif isinstance(sessions, DataFrame):
            ids = sessions.select("session_id").distinct()
            rows = self._current(name, last, self._buckets_of(ids))
            rows = rows.join(ids.withColumnRenamed("session_id", column), column, "left_semi")
        else:
            ids = self.spark.createDataFrame([(s,) for s in sessions], "session_id string")
            rows = self._current(name, last, self._buckets_of(ids))
            rows = rows.filter(F.col(column).isin(sessions))
        return rows.select(*schema.ALL_TABLES[name].names)

    def tables(self, sessions: list[str] | None = None) -> Tables:
        names = schema.ALL_TABLES if self.kept_up else schema.RECORDED
        return Tables({n: (lambda n=n: self.table(n, sessions)) for n in names})

    def replace(self, tables: dict[str, DataFrame], sessions: DataFrame, tries: int = 5) -> None:
        """Puts the given sessions' rows in place of whatever the store holds of them, then merges
        layers that have grown alike."""
        for name, new in tables.items():
            drift = shape_differences(new, name)
            if drift:
                raise ValueError(f"{name}: {', '.join(drift)}")
        last = self._last()
        if last is not None and last[1] < SCHEMA_VERSION:
            self.merge()
        ids = sessions.select("session_id").distinct()
        written = self._written(tables, ids)
        for _ in range(tries):
            last = self._last()
            layers = self._layers(last)
            # What is kept up follows from the state it is added to, so it is found anew for each.
            derived = upkeep.derived(self, tables, ids) if self.kept_up else []
            for name, layer in [*written, *(w for group in derived for w in self._written(*group))]:
                layers[name] = [*layers.get(name, []), layer]
            if self._commit(last, layers):
                return self.compact()
        raise Busy(f"{self.root}: {tries} writes were overtaken")

    def _written(self, tables: dict[str, DataFrame], ids: DataFrame) -> list[tuple[str, tuple[str, int]]]:
        """Writes a version of each relation that replaces the sessions of `ids`."""
        version = uuid.uuid4().hex
        self._write(ids.withColumn("bucket", bucket_of(F.col("session_id"), self.buckets)), REPLACED, version)
        for name, new in tables.items():
            self._write(new.withColumn("bucket", self._bucket(name)), name, version)
        return [(name, (version, self._size(name, version))) for name in tables]

    def compact(self) -> bool:
        """Merges each relation's last layers where `FAN` or more of like size stand: a layer goes with the
        one before while all behind that are half its size. Whether it was done: another writer's commit
        goes first, and the next write tries again."""
        last = self._last()
        layers, changed = self._layers(last), False
        for name, held in layers.items():
            begin = len(held) - 1
            size = held[begin][1]
            while begin and 2 * size >= held[begin - 1][1]:
                begin -= 1
                size += held[begin][1]
            if len(held) - begin >= FAN:
                layers[name], changed = [*held[:begin], self._merged(name, held[begin:], begin > 0)], True
        return changed and self._commit(last, layers)

    def _merged(self, name: str, run: list[tuple[str, int]], on_top: bool) -> tuple[str, int]:
        """One layer in place of a run of them. What it replaces is needed only on top of another."""
        versions, version = [v for v, _ in run], uuid.uuid4().hex
        self._write(self._live(name, versions, schema.ALL_TABLES[name], None), name, version)
        if on_top:
            replaced = self._folders(REPLACED, versions, REPLACED_SHAPE)
            self._write(replaced.select("session_id", "bucket").distinct(), REPLACED, version)
        return version, self._size(name, version)

    def merge(self, tries: int = 5) -> None:
        """Writes every relation anew as one layer, in today's columns."""
        for _ in range(tries):
            last, version = self._last(), uuid.uuid4().hex
            if last is None:
                return
            whole = {}
            for name in schema.ALL_TABLES:
                self._write(self._current(name, last), name, version)
                whole[name] = [(version, self._size(name, version))]
            if self._commit(last, whole):
                return
        raise Busy(f"{self.root}: {tries} merges were overtaken")

    def _write(self, rows: DataFrame, name: str, version: str) -> None:
        """Rows of a session lie together in their bucket, so a reader of one skips the rest."""
        column = schema.session_column(name) if name in schema.ALL_TABLES else "session_id"
        (
            rows.repartition(F.col("bucket"), bucket_salt(name))
            .sortWithinPartitions("bucket", column)
            .write.partitionBy("bucket").mode("errorifexists")
            .parquet(f"{self.root}/tables/{name}/{WRITE}={version}")
        )

    def _size(self, name: str, version: str) -> int:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/tables/{name}/{WRITE}={version}")
        return self._files()[1].getContentSummary(path).getLength()

    def _commit(self, last: tuple[int, int, str] | None, layers: dict[str, list[tuple[str, int]]]) -> bool:
        """Whether the manifest after `last` is ours. A manifest has a line per relation and layer."""
        text = "".join(
            f"{name},{layer},{version},{size}\n"
            for name, held in sorted(layers.items()) for layer, (version, size) in enumerate(held)
        )
        number = 1 if last is None else last[0] + 1
        return create(self.spark, f"{self.root}/manifests", f"{number:012d}-v{SCHEMA_VERSION}.csv", text)


def in_order(versions: list[str]) -> Column:
    """The number of a row's layer."""
    pairs = [F.lit(x) for k, v in enumerate(versions) for x in (v, k)]
    return F.create_map(*pairs)[F.col(WRITE)]


def bucket_salt(name: str) -> Column:
    """Spreads one bucket's rows of a fat relation over several tasks, so a huge session is split."""
    ways = 16 if name in ("raw_records", "tool_calls", "api_calls") else 1
    return F.pmod(F.xxhash64(*schema.KEYS[name]), F.lit(ways)) if ways > 1 else F.lit(0)


@dataclass
class Refresh:
    """What a refresh did: every session's status, why some were withheld, which last lines were still
    being written, what nobody declared."""

    status: DataFrame
    rejects: DataFrame
    tails: DataFrame | None = None
    kinds: DataFrame | None = None
    fields: DataFrame | None = None

    def report(self) -> DataFrame:
        """Per directory: sessions by what became of them, and last lines dropped."""
        count = lambda what: F.count_if(F.col("status") == what).alias(what)
        told = self.status.withColumn("dropped_tails", F.lit(0))
        if self.tails is not None:
            dropped = self.tails.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
            told = self.status.join(dropped, "session_id", "left").withColumn(
                "dropped_tails", F.coalesce("n", F.lit(0))
            )
        return told.groupBy("project_folder").agg(
            F.count(F.lit(1)).alias("sessions"), count("extracted"), count("refused"), count("skipped"),
            F.sum("dropped_tails").alias("dropped_tails"),
        )


def changed_sessions(store: Store, files: DataFrame) -> DataFrame:
    """Every session on disk with its fingerprint and whether the store already holds that state."""
    now = fingerprints(files.filter(F.col("session_id").isNotNull()), EXTRACTOR_VERSION).filter(
        F.col("transcript_path").isNotNull()
    )
    held = store.table("extract_state").select("session_id", F.col("fingerprint").alias("held"))
    return now.join(held, "session_id", "left").withColumn(
        "changed", ~F.col("fingerprint").eqNullSafe(F.col("held"))
    )


def refresh(store: Store, root: str, tags: dict[str, str] | None = None) -> Refresh:
    """Reads what changed since it was last read. A session that fails leaves the others alone.

    Sessions whose files are gone stay as they are.
    """
    spark = store.spark
    files = keep(listing(spark, root), "listing")
    state = keep(changed_sessions(store, files), "changed_sessions")
    due = state.filter("changed")
    if due.isEmpty():
        nothing = spark.createDataFrame([], "session_id string, rule string, detail string")
        skipped = F.lit("skipped").alias("status")
        return Refresh(state.select("session_id", "project_folder", skipped), nothing)
    return _taken(store, recorded(spark, root, due, files), state, tags)


def _taken(
    store: Store, found: Recorded, state: DataFrame, tags: dict[str, str] | None, positions: DataFrame | None = None
) -> Refresh:
    """Extracts what was found and puts it in the store. `state` has every session's fingerprint and
    whether it changed; `positions`, how far each transcript has been read."""
    due = state.filter("changed")
    out = extract(found.lines, found.metas, found.paths)
    layout = layout_errors(found.files)
    rejects = keep(out.rejects.unionByName(layout), "refused")
    bad = rejects.select("session_id").distinct()
    good = keep(due.join(bad, "session_id", "left_anti"), "extracted")
    tables = {
        name: _only(rows, name, good) for name, rows in out.tables.items()
    }
    tables["offload_files"] = _only(found.offloads, "offload_files", good)
    if tags is None and positions is not None:
        tables["session_tags"] = store.table("session_tags", good)
    else:
        named = F.create_map(*[F.lit(x) for pair in (tags or {}).items() for x in pair])
        tables["session_tags"] = good.select(
            "session_id", F.explode(named.cast("map<string,string>")).alias("key", "value")
        )
    if positions is None:
        positions = store.spark.createDataFrame([], schema.ALL_TABLES["read_positions"])
    tables["read_positions"] = _only(positions, "read_positions", good)
    tables["extract_state"] = good.select(
        "session_id", "fingerprint", "transcript_path",
        F.current_timestamp().alias("extracted_at"), F.lit(EXTRACTOR).alias("extractor"),
        F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
    )
    store.replace(tables, good)
    refused = bad.withColumn("refused", F.lit(True))
    status = state.join(refused, "session_id", "left").select(
        "session_id", "project_folder",
        F.when(~F.col("changed"), "skipped").when(F.col("refused"), "refused")
        .otherwise("extracted").alias("status"),
    )
    return Refresh(status, rejects, out.tails, unknown_kinds(out.lines), unknown_fields(out.lines))


def append(store: Store, root: str, arrived: DataFrame, tags: dict[str, str] | None = None) -> Refresh | None:
    """Takes up lines that were written behind what the store has read, from `tail.line_stream`.

    What a session had before comes from the lines the store keeps, so of its files only the new
    bytes are read. How far each file has been read is stored with the rows it led to, in the same
    commit: a batch that comes twice finds its lines read, and lines that do not follow on what was read
    (of a session refused before, of a file written anew or read by `refresh`) send their session
    through its whole files, as far as the batch reaches. Tags stay unless new ones are given.
    """
    spark = store.spark
    arrived = keep(arrived, "arrived")
    ends = arrived.groupBy("file").agg(F.max("end").alias("end"), F.max("rewritten").alias("rewritten"))
    ends = keep(classified(ends, root).filter(F.col("role").isin("main", "agent", "journal")), "ends")
    if ends.isEmpty():
        return None
    sessions = ends.select("session_id").distinct()
    read = keep(store.table("read_positions", sessions), "read")
    whole_before = store.table("extract_state", sessions).select("session_id").join(
        read.select("session_id").distinct(), "session_id", "left_anti"
    )
    told = ends.join(read.select("file", "bytes", "lines"), "file", "left")
    fresh = arrived.join(told.select("file", "session_id", "source", "bytes", "lines"), "file").filter(
        F.col("at") >= F.coalesce("bytes", F.lit(0))
    )
    fresh = keep(fresh, "fresh")
    first = fresh.groupBy("file").agg(F.min("at").alias("first"))
    gap = told.join(first, "file").filter(F.col("first") != F.coalesce("bytes", F.lit(0)))
    # Which sessions go through their whole files, and which have nothing new at all.
    anew = keep(
        gap.select("session_id").unionByName(told.filter("rewritten").select("session_id"))
        .unionByName(whole_before).distinct(), "anew",
    )
    due = keep(fresh.select("session_id").unionByName(anew).distinct(), "due")
    if due.isEmpty():
        return None
    files = keep(listing(spark, root).join(due, "session_id", "left_semi"), "files")
    transcripts = files.filter(F.col("role").isin("main", "agent", "journal"))
    # A file of a session read anew that is not in the batch is read as far as it reaches now.
    held = read.select("file", F.col("bytes").alias("held"), F.col("lines").alias("held_lines"))
    reach = keep(
        transcripts.select("file", "session_id", "source", "length")
        .join(told.select("file", "end", "rewritten"), "file", "left").join(held, "file", "left"), "reach",
    )
    again = reach.join(anew, "session_id", "left_semi").withColumn(
        "end", F.when(F.col("rewritten"), F.col("end")).otherwise(F.coalesce(F.greatest("end", "held"), "length"))
    )
    from_start = numbered(lines_upto(again)).join(again.select("file", "session_id", "source"), "file")
    on_top = numbered(fresh.join(anew, "session_id", "left_anti")).withColumn(
        "place", F.col("place") + F.coalesce("lines", F.lit(0))
    )
    stop = (F.col("at") + F.octet_length("raw") + 1).alias("stop")
    shape = ("session_id", "source", F.col("place").cast("int").alias("line_no"), "raw", "file", stop)
    new = keep(on_top.select(*shape).unionByName(from_start.select(*shape)), "new_lines")
    kept = store.table("raw_records", due.join(anew, "session_id", "left_anti"))
    lines = kept.select("session_id", "source", "line_no", "raw").unionByName(new.drop("file", "stop"))
    counted = new.groupBy("file").agg(F.max("line_no").alias("new"), F.max("stop").alias("stop"))
    positions = reach.join(counted, "file", "left").select(
        "session_id", "source", "file", F.coalesce("stop", "held", F.lit(0)).cast("long").alias("bytes"),
        F.coalesce("new", "held_lines", F.lit(0)).cast("long").alias("lines"),
    )
    positions = keep(positions, "positions")
    upto = files.join(positions.select("file", "bytes"), "file", "left")
    upto = upto.withColumn("length", F.coalesce("bytes", "length")).drop("bytes")
    state = fingerprints(upto, EXTRACTOR_VERSION).filter(F.col("transcript_path").isNotNull())
    state = keep(state.withColumn("changed", F.lit(True)), "changed_sessions")
    found = Recorded(files, lines, metas(spark, root, files), offload_files(spark, root, files), paths(files))
    return _taken(store, found, state, tags, positions)


def _only(rows: DataFrame, name: str, good: DataFrame) -> DataFrame:
    column = schema.session_column(name)
    named = good.select(F.col("session_id").alias(column))
    return rows.join(named, column, "left_semi").select(*schema.ALL_TABLES[name].names)


def session_bundle(t: Tables, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Sessions read back whole: every relation in the order its rows are kept in."""
    order = {
        "turns": ["source", "index"], "api_calls": ["source", "index"],
        "tool_calls": ["source", "index"], "agent_runs": ["started_at", "id"],
        "compactions": ["timestamp", "id"], "interjections": ["timestamp", "id"],
        "pr_links": ["line_no"], "raw_records": ["source", "line_no"], "session_tags": ["key"],
        "offload_files": ["name"],
    }
    return {
        n: t[n].orderBy("session_id", *order[n]) for n in (names or order)
    }


def migrated(df: DataFrame, table: str, held_version: int, runs: DataFrame | None = None) -> DataFrame:
    """A stored relation of an older version in today's columns."""
    if held_version > SCHEMA_VERSION:
        raise ValueError(f"store version {held_version} is newer than {SCHEMA_VERSION}")
    if table == "agent_runs" and held_version < 8 and "description" in df.columns:
        df = df.withColumnRenamed("description", "brief")
    if table == "compactions" and held_version < 9 and "replayed" not in df.columns:
        # What a fork holds from before its own first record came with the history it copied.
        if runs is None:
            raise ValueError("compactions before version 9 need the runs of their store")
        forks = runs.filter("is_fork").select(
            "session_id", F.col("id").alias("source"), F.lit(True).alias("_fork"),
            F.col("started_at").alias("_start"),
        )
        early = F.col("_start").isNull() | (F.col("timestamp") <= F.col("_start"))
        df = df.join(forks, ["session_id", "source"], "left").withColumn(
            "replayed", F.coalesce(F.col("_fork") & early, F.lit(False))
        )
    for f in schema.ALL_TABLES[table].fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*schema.ALL_TABLES[table].names)
