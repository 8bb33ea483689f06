"""The relations every report reads: live rows, corpus rows, rollups, and the sessions in scope."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import schema
from sessionlake.functions.text import under_path
from sessionlake.functions.times import millis_between, within_days
from sessionlake.session import keep

WINDOW_DAYS = 28


@dataclass(frozen=True)
class Scope:
    """Which sessions a corpus report covers, and the day its trailing window ends on."""

    project: str
    as_of: str
    since: str | None = None
    window_days: int = WINDOW_DAYS


class Tables:
    """The stored relations by name, and the ones derived from them, built once each."""

    def __init__(self, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> None:
        self.frames = dict(frames)
        self._derived: dict[tuple[str, str], DataFrame] = {}

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> Tables:
        return cls(
            {
                name: spark.read.schema(shape).parquet(f"{root}/{name}")
                for name, shape in schema.RECORDED.items()
            }
        )

    def __getitem__(self, name: str) -> DataFrame:
        if not isinstance(self.frames[name], DataFrame):
            self.frames[name] = self.frames[name]()
        return self.frames[name]

    def once(self, kind: str, name: str, build) -> DataFrame:
        if (kind, name) not in self._derived:
            self._derived[kind, name] = build()
        return self._derived[kind, name]

    def live(self, name: str) -> DataFrame:
        """What counts for the session whose files hold it: everything but a fork's copies."""
        table = self[name]
        return table.filter(~F.col("replayed")) if "replayed" in table.columns else table

    def corpus(self, name: str) -> DataFrame:
        """What counts across sessions: a resumed copy stays with the session that ran it first."""
        return self.once("corpus", name, lambda: self._without_copies(name))

    def rollups(self, family: str) -> DataFrame:
        """One narrow row per session, kept: nearly every report reads it."""
        if "session_rollups" in self.frames:  # an archive that keeps them up
            return self["session_rollups"].filter(F.col("family") == family).drop("family")
        return self.once(
            "rollups", family, lambda: keep(rollups(self, family), f"{family}_rollups")
        )

    def prepare(self, names: list[str]) -> None:
        """Finds the copies of several relations at once; the searches do not wait on each other."""
        for name in names:
            _ = self[name]
        with ThreadPoolExecutor(max_workers=len(names)) as pool:
            list(pool.map(self.corpus, names))

    def family(self, family: str, name: str) -> DataFrame:
        return self.live(name) if family == "live" else self.corpus(name)

    @cached_property
    def opened(self) -> DataFrame:
        """Sessions by a sortable start: the earliest first, an unknown start last, then the id."""
        return self["sessions"].select(
            F.col("id").alias("session_id"),
            F.struct(
                F.col("started_at").isNull().alias("unknown"),
                F.col("started_at").alias("at"),
                F.col("id").alias("session_id"),
            ).alias("opened"),
        )

    def copies(self, name: str) -> DataFrame:
        """(id, session_id) pairs whose id an earlier session already holds.

        Only ids seen under two sessions get this far, so what the fat table is matched against
        is the resumed copies and not the corpus.
        """
        if "copied_ids" in self.frames:  # an archive that keeps them up
            return self["copied_ids"].filter(F.col("relation") == name).select("id", "session_id")
        pairs = self.live(name).select("id", "session_id")
        shared = (
            pairs.groupBy("id")
            .agg(F.min("session_id").alias("_lo"), F.max("session_id").alias("_hi"))
            .filter(F.col("_lo") != F.col("_hi"))
            .select("id")
        )
        held = pairs.join(shared, "id", "left_semi").distinct().join(self.opened, "session_id")
        owner = held.groupBy("id").agg(F.min("opened").alias("first"))
        return (
            held.join(owner, "id")
            .filter(F.col("session_id") != F.col("first.session_id"))
            .select("id", "session_id")
        )

    def _without_copies(self, name: str) -> DataFrame:
        if "copied_ids" in self.frames:
            copies = self.copies(name)
        else:
            copies = self.once("copies", name, lambda: keep(self.copies(name), f"copies_{name}"))
        return self.live(name).join(copies, ["id", "session_id"], "left_anti")


def rollups(t: Tables, family: str) -> DataFrame:
    """One row per session with its counts; a session with none of a kind still shows the zero."""

    def counted(name: str, alias: str) -> DataFrame:
        return t.family(family, name).groupBy("session_id").agg(F.count(F.lit(1)).alias(alias))

    tokens = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    calls = (
        t.family(family, "api_calls")
        .groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("api_calls"),
            *[F.sum(c).alias(c) for c in tokens],
            F.sum("cost_usd").alias("cost_usd"),
            F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
        )
    )
    if family == "corpus":
        t.prepare(["turns", "api_calls", "tool_calls", "agent_runs", "compactions"])
    wide = t["sessions"].select(
        F.col("id").alias("session_id"),
        "project_dir",
        "title",
        "started_at",
        "ended_at",
        millis_between(F.col("started_at"), F.col("ended_at")).alias("wall_ms"),
        "active_ms",
    )
    measures = [
        counted("turns", "turns"),
        calls,
        counted("tool_calls", "tool_calls"),
        counted("agent_runs", "agent_runs"),
        counted("compactions", "compactions"),
    ]
    for measure in measures:
        wide = wide.join(measure, "session_id", "left")
    names = [
        "turns", "api_calls", "tool_calls", "agent_runs", "compactions", *tokens, "cost_usd",
        "unpriced_api_calls",
    ]
    return wide.select(
        "session_id", "project_dir", "title", "started_at", "ended_at", "wall_ms", "active_ms",
        *[F.coalesce(F.col(c), F.lit(0.0 if c == "cost_usd" else 0)).alias(c) for c in names],
    )


def project_sessions(t: Tables, scope: Scope) -> DataFrame:
    """The project's own sessions and those below it, each with whether the window holds it."""
    rows = t["sessions"].filter(under_path(F.col("project_dir"), scope.project))
    if scope.since is not None:
        rows = rows.filter(F.col("started_at") >= F.to_date(F.lit(scope.since)).cast("timestamp"))
    return rows.select(
        F.col("id").alias("session_id"),
        "started_at",
        within_days(F.col("started_at"), scope.as_of, scope.window_days).alias("in_window"),
    )


def periods(in_window: str | Column = "in_window") -> Column:
    """The one or two periods a session counts in, as rows: the corpus, and the window inside it."""
    flag = F.col(in_window) if isinstance(in_window, str) else in_window
    return F.explode(
        F.when(flag, F.array(F.lit("corpus"), F.lit("trailing_window"))).otherwise(
            F.array(F.lit("corpus"))
        )
    ).alias("period")


def by_period(t: Tables, scope: Scope, per_session: DataFrame) -> DataFrame:
    """Per-session aggregates fanned out over the periods, never the rows under them."""
    held = project_sessions(t, scope).select("session_id", "in_window")
    return held.join(per_session, "session_id").select(periods(), *per_session.columns)


def unplaceable(t: Tables) -> DataFrame:
    """How many sessions no project can hold, because they recorded none."""
    return t["sessions"].agg(F.count_if(F.col("project_dir").isNull()).alias("sessions"))


def tagged(t: Tables, key: str, value: str) -> DataFrame:
    return (
        t["session_tags"]
        .filter((F.col("key") == key) & (F.col("value") == value))
        .select("session_id")
    )


def describable_sessions(t: Tables) -> DataFrame:
    """Sessions that drove a model response: the ones a description can be written for."""
    r = t.rollups("live")
    worked = ((F.col("turns") > 0) | (F.col("agent_runs") > 0)) & (F.col("api_calls") > 0)
    return r.filter(worked).select("session_id")


_SAID = [
    "description", "category", "outcome", "friction", "input_hash", "prompt_version",
    "taxonomy_version", "enriched_at",
]


def _said(t: Tables, table: str, keys: list[str]) -> DataFrame:
    return t[table].select(*keys, *_SAID, F.col("model").alias("enrichment_model"))


def enriched_turns(t: Tables) -> DataFrame:
    said = _said(t, "turn_enrichments", ["session_id", "source", "turn_id"])
    return t.live("turns").join(
        said.withColumnRenamed("turn_id", "id"), ["session_id", "source", "id"], "left"
    )


def enriched_agent_runs(t: Tables) -> DataFrame:
    said = _said(t, "agent_run_enrichments", ["session_id", "agent_run_id"])
    return (
        t.live("agent_runs")
        .withColumnRenamed("model", "agent_model")
        .join(said.withColumnRenamed("agent_run_id", "id"), ["session_id", "id"], "left")
    )


def enriched_sessions(t: Tables) -> DataFrame:
    return t.rollups("live").join(
        _said(t, "session_enrichments", ["session_id"]), "session_id", "left"
    )


def folded_projects(directories: DataFrame, column: str = "project_dir") -> DataFrame:
    """Each directory with the shortest recorded directory it lies under.

    A prefix match written as an equality: every ancestor of a directory is looked up among the
    recorded ones, so no directory is compared with all the others.
    """
    known = directories.select(column).filter(F.col(column).isNotNull()).distinct()
    parts = F.split(column, "/", -1)
    depth = F.size(parts)
    ancestors = F.transform(
        F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    climbed = known.select(column, F.explode(ancestors).alias("root"))
    return (
        climbed.join(known.select(F.col(column).alias("root")), "root")
        .groupBy(column)
        .agg(F.min_by("root", F.length("root")).alias("root"))
    )
