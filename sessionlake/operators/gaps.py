"""What threads did between calls: silences, rebuilt contexts, and recoveries after a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.context import rebuilt_context
from sessionlake.functions.text import directory_of
from sessionlake.functions.times import seconds_between, shifted
from sessionlake.functions.tools import json_field
from sessionlake.operators.corpus import MAIN_THREAD, money
from sessionlake.operators.relations import Scope, Tables, by_period, periods, project_sessions
from sessionlake.operators.windows import THREAD, previous, running

MIN_REBUILT_TOKENS = 20_000
MIN_REBUILT_PCT = 90
IDLE_SECONDS = 300


def _followed_calls(t: Tables, scope: Scope) -> DataFrame:
    """The calls in scope, each beside the one before it in its thread.

    Computed before any period fan-out: a doubled call would be compared with its own copy.
    """
    held = project_sessions(t, scope).select("session_id")
    calls = (
        t.corpus("api_calls")
        .select(
            *THREAD, "index", "started_at", "cache_read_tokens", "cache_creation_tokens",
            "cache_1h_tokens", "cost_usd",
        )
        .join(held, "session_id", "left_semi")
    )
    return previous(
        calls, "index",
        {"previous_start": F.col("started_at"), "previous_1h": F.col("cache_1h_tokens")},
    )


def _agent_of_thread(t: Tables) -> DataFrame:
    return t.corpus("agent_runs").select(
        "session_id", F.col("id").alias("source"), "agent_type"
    )


def _after_compaction(rebuilt: DataFrame, compactions: DataFrame) -> DataFrame:
    """The rebuilding calls with a compaction between the call before and themselves, both ends a second
    later. Calls and compactions stand in one order of time, and a call asks for the latest compaction so
    far: no call is compared with all compactions of its thread."""
    calls = rebuilt.select(
        *THREAD, shifted(F.col("started_at"), 1).alias("at"), shifted(F.col("previous_start"), 1).alias("since")
    )
    pressed = compactions.select(
        *THREAD, F.col("timestamp").alias("at"), F.lit(None).cast("timestamp").alias("since")
    )
    events = calls.unionByName(pressed).filter(F.col("at").isNotNull()).withColumn("asks", F.col("since").isNotNull())
    folded = running(
        events, THREAD, F.to_date("at"), ["at", "asks"], maxes={"latest": F.when(~F.col("asks"), F.col("at"))}
    )
    return folded.filter(F.col("asks") & (F.col("latest") > F.col("since")))


def context_reloads(
    t: Tables,
    scope: Scope,
    min_rebuilt_tokens: int = MIN_REBUILT_TOKENS,
    min_rebuilt_pct: int = MIN_REBUILT_PCT,
    idle_seconds: int = IDLE_SECONDS,
) -> DataFrame:
    """What threads paid to rebuild a context they had: the corpus, each agent type, each thread.

    A compaction belongs to the call after it; both ends of that span slide by one second, which
    keeps the spans of neighbouring calls apart.
    """
    calls = _followed_calls(t, scope)
    rebuilt = calls.filter(
        F.col("previous_start").isNotNull()
        & rebuilt_context(
            F.col("cache_creation_tokens"), F.col("cache_read_tokens"),
            min_rebuilt_tokens, min_rebuilt_pct,
        )
    )
    compacting = _after_compaction(rebuilt, t.corpus("compactions")).groupBy(*THREAD).agg(
        F.count(F.lit(1)).alias("compaction_reloads")
    )
    idle = seconds_between(F.col("previous_start"), F.col("started_at")) >= idle_seconds
    reloads = rebuilt.groupBy(*THREAD).agg(
        F.count(F.lit(1)).alias("reloads"),
        F.count_if(idle).alias("idle_reloads"),
        F.sum("cache_creation_tokens").alias("rebuilt_tokens"),
        F.sum("cost_usd").alias("reload_cost_usd"),
    )
    whole = calls.groupBy(*THREAD).agg(
        F.sum("cost_usd").alias("thread_cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
    )
    threads = (
        reloads.join(compacting, THREAD, "left")
        .join(whole, THREAD)
        .join(_agent_of_thread(t), THREAD, "left")
        .select(
            *THREAD, F.coalesce("agent_type", F.lit(MAIN_THREAD)).alias("agent_type"), "reloads",
            "idle_reloads", F.coalesce("compaction_reloads", F.lit(0)).alias("compaction_reloads"),
            "rebuilt_tokens", "reload_cost_usd", "thread_cost_usd", "unpriced_api_calls",
        )
    )
    sums = ("reloads", "idle_reloads", "compaction_reloads", "rebuilt_tokens")
    grains = by_period(t, scope, threads).groupingSets(
        [["period"], ["period", "agent_type"], ["period", "agent_type", "session_id", "source"]],
        "period", "agent_type", "session_id", "source",
    ).agg(
        F.grouping("agent_type").alias("_all_types"),
        F.grouping("session_id").alias("_all_threads"),
        F.count(F.lit(1)).alias("threads"),
        F.count_distinct("session_id").alias("_sessions"),
        *[F.sum(c).alias(c) for c in sums],
        money(F.sum("reload_cost_usd"), 2).alias("reload_cost_usd"),
        money(F.sum("thread_cost_usd"), 2).alias("thread_cost_usd"),
        F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
    )
    every_type, every_thread = F.col("_all_types") == 1, F.col("_all_threads") == 1
    everything = F.lit("(all)")
    return grains.select(
        "period",
        F.when(every_type, "corpus").when(every_thread, "agent_type").otherwise("thread")
        .alias("grain"),
        F.when(every_type, everything).otherwise(F.col("agent_type")).alias("agent_type"),
        F.when(every_thread, everything).otherwise(F.col("session_id")).alias("session_id"),
        F.when(every_thread, everything).otherwise(F.col("source")).alias("source"),
        "threads",
        F.col("_sessions").alias("sessions"),
        *sums,
        "reload_cost_usd",
        "thread_cost_usd",
        "unpriced_api_calls",
    )


def _silences(
    t: Tables, scope: Scope, min_idle_seconds: int, min_rebuilt_tokens: int, min_rebuilt_pct: int
) -> DataFrame:
    return (
        _followed_calls(t, scope)
        .select(
            *THREAD,
            F.col("previous_start").alias("gap_start"),
            seconds_between(F.col("previous_start"), F.col("started_at")).alias("idle_seconds"),
            rebuilt_context(
                F.col("cache_creation_tokens"), F.col("cache_read_tokens"),
                min_rebuilt_tokens, min_rebuilt_pct,
            ).alias("reloaded"),
            F.col("cache_creation_tokens").alias("rebuilt_tokens"),
            (F.coalesce("previous_1h", F.lit(0)) > 0).alias("cached_1h"),
        )
        .filter(F.col("idle_seconds") >= min_idle_seconds)
        .join(_agent_of_thread(t), THREAD, "left")
        .withColumn("agent_type", F.coalesce("agent_type", F.lit(MAIN_THREAD)))
    )


def idle_gaps(
    t: Tables,
    scope: Scope,
    min_idle_seconds: int = IDLE_SECONDS,
    min_rebuilt_tokens: int = MIN_REBUILT_TOKENS,
    min_rebuilt_pct: int = MIN_REBUILT_PCT,
) -> DataFrame:
    """One row per silence between two calls of a thread, start to start."""
    gaps = _silences(t, scope, min_idle_seconds, min_rebuilt_tokens, min_rebuilt_pct)
    held = project_sessions(t, scope).select("session_id", "in_window")
    return gaps.join(held, "session_id").select(
        "in_window", *THREAD, "agent_type", "gap_start", "idle_seconds", "reloaded",
        "rebuilt_tokens", "cached_1h",
    )


def reload_cost_split(
    t: Tables,
    scope: Scope,
    short_gap_seconds: int,
    min_idle_seconds: int = IDLE_SECONDS,
    min_rebuilt_tokens: int = MIN_REBUILT_TOKENS,
    min_rebuilt_pct: int = MIN_REBUILT_PCT,
) -> DataFrame:
    """Tokens rebuilt after short silences against long ones; the bound is the caller's claim."""
    short = F.col("idle_seconds") < short_gap_seconds
    tokens = F.col("rebuilt_tokens")
    zero = F.lit(0)
    per_session = (
        _silences(t, scope, min_idle_seconds, min_rebuilt_tokens, min_rebuilt_pct)
        .groupBy("session_id", "agent_type")
        .agg(
            F.count(F.lit(1)).alias("gaps"),
            F.count_if(short).alias("short_gaps"),
            F.count_if("reloaded").alias("reloads"),
            F.count_if(F.col("reloaded") & short).alias("short_reloads"),
            F.sum(F.when(F.col("reloaded"), tokens).otherwise(zero)).alias("rebuilt_tokens"),
            F.sum(F.when(F.col("reloaded") & short, tokens).otherwise(zero))
            .alias("short_rebuilt_tokens"),
        )
    )
    sums = [c for c in per_session.columns if c not in ("session_id", "agent_type")]
    grains = by_period(t, scope, per_session).groupingSets(
        [["period"], ["period", "agent_type"]], "period", "agent_type"
    ).agg(F.grouping("agent_type").alias("_all"), *[F.sum(c).alias(c) for c in sums])

    def share(part: str, whole: str):
        return F.round(F.lit(100.0) * F.col(part) / F.nullif(F.col(whole), zero), 1)

    return grains.select(
        "period",
        F.when(F.col("_all") == 1, "corpus").otherwise("agent_type").alias("grain"),
        F.when(F.col("_all") == 1, "(all)").otherwise(F.col("agent_type")).alias("agent_type"),
        *sums,
        share("short_reloads", "reloads").alias("short_reload_pct"),
        share("short_rebuilt_tokens", "rebuilt_tokens").alias("short_token_pct"),
    )


# What looks at a directory, and what became of a failure.
LISTING_TOOLS = ("Glob", "LS")
LISTING_COMMAND = r"(^|[;&|]\s*)(ls|find|tree|rg --files)\b"
RECOVERIES = {1: "listed the directory", 2: "listed elsewhere", 3: "no listing"}


def missing_file_recovery(
    t: Tables, scope: Scope, within_calls: int = 1, missing: str | None = None
) -> DataFrame:
    """What a thread did in the calls right after a file tool failed on the path it named.

    Every failure falls in one of three dispositions and every disposition keeps its row. A failure
    meets the calls after it on their position, one equality per step, so a long thread is spread
    over tasks by position and no range is searched.
    """
    calls = t.corpus("tool_calls")
    path = json_field(F.col("input"), "file_path")
    # With no calls to look at, a failure still keeps its row.
    steps = [F.col("index") + k for k in range(1, within_calls + 1)] or [F.lit(None).cast("int")]
    failed = calls.filter("is_error")
    if missing is not None:
        failed = failed.filter(F.contains("result", F.lit(missing)))
    failed = failed.select(
        *THREAD, "index", path.alias("path")
    ).filter(F.col("path").isNotNull()).select(
        *THREAD, "index", directory_of(F.col("path")).alias("directory"),
        F.explode(F.array(*steps)).alias("at"),
    )
    asked = F.coalesce(json_field(F.col("input"), "command"), F.lit(""))
    looks = calls.filter(
        F.col("name").isin(*LISTING_TOOLS) | asked.rlike(LISTING_COMMAND)
    ).select(*THREAD, F.col("index").alias("at"), F.col("input").alias("looked_at"))
    listing = F.col("looked_at").isNotNull()
    exact = listing & (F.col("directory") != "") & F.contains("looked_at", F.col("directory"))
    judged = (
        failed.join(looks, [*THREAD, "at"], "left")
        .groupBy(*THREAD, "index")
        .agg(F.min(F.when(exact, 1).when(listing, 2).otherwise(3)).alias("rank"))
    )
    per_session = (
        judged.groupBy(*THREAD, "rank")
        .agg(F.count(F.lit(1)).alias("failures"))
        .groupBy("session_id", "rank")
        .agg(F.sum("failures").alias("failures"), F.count(F.lit(1)).alias("threads"))
    )
    counted = (
        by_period(t, scope, per_session)
        .groupBy("period", "rank")
        .agg(
            F.sum("failures").alias("failures"),
            F.count(F.lit(1)).alias("sessions"),
            F.sum("threads").alias("threads"),
        )
    )
    names = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(n).alias("recovery"))
                  for r, n in RECOVERIES.items()])
    )
    every = (
        project_sessions(t, scope)
        .select(periods())
        .distinct()
        .select("period", names.alias("d"))
        .select("period", "d.rank", "d.recovery")
    )
    zero = F.lit(0)
    return every.join(counted, ["period", "rank"], "left").select(
        "period", "recovery",
        *[F.coalesce(c, zero).alias(c) for c in ("failures", "sessions", "threads")],
    )
