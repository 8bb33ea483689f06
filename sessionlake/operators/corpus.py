"""Counts over the sessions in scope: spend, tools, failures, agents, skills, commands.

Each report first aggregates the rows of a session (or thread) where they lie, then fans the small
result out over the periods, so the fat tables are read once and never doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlake.functions.text import (
    collapse,
    command_head,
    directory_of,
    invocation,
    is_chained,
    path_tail,
    signature_line,
)
from sessionlake.functions.times import iso_week
from sessionlake.functions.tools import json_field
from sessionlake.operators.relations import (
    Scope,
    Tables,
    by_period,
    periods,
    project_sessions,
    tagged,
)
from sessionlake.operators.windows import distinct_ranks
from sessionlake.schema import MAIN

MAIN_THREAD = "(main thread)"
MEASURES = ("turns", "api_calls", "tool_calls", "agent_runs", "compactions")
SIGNATURE_CHARS = 80
COMMAND_HEAD_CHARS = 60


def money(column: Column, places: int = 4) -> Column:
    return F.round(column, places)


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("sessions"),
        *[F.sum(m).alias(m) for m in MEASURES],
        money(F.sum("cost_usd")).alias("cost_usd"),
        F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
    ]


def session_counts(t: Tables, scope: Scope) -> DataFrame:
    """The corpus and its trailing window, one row each."""
    return by_period(t, scope, t.rollups("corpus")).groupBy("period").agg(*_totals())


def sessions(t: Tables, scope: Scope) -> DataFrame:
    """Every session in scope with what it is ranked on."""
    held = project_sessions(t, scope).select("session_id", "in_window")
    return held.join(t.rollups("corpus"), "session_id").select(
        "session_id", "started_at", "in_window", *MEASURES,
        money(F.col("cost_usd")).alias("cost_usd"), "unpriced_api_calls",
    )


def tagged_sessions(t: Tables, scope: Scope, key: str, value: str) -> DataFrame:
    return sessions(t, scope).join(tagged(t, key, value), "session_id", "left_semi")


def weekly_trend(t: Tables, scope: Scope) -> DataFrame:
    held = project_sessions(t, scope).select("session_id")
    return (
        t.rollups("corpus")
        .join(held, "session_id", "left_semi")
        .groupBy(iso_week(F.col("started_at")).alias("week"))
        .agg(*_totals())
    )


def cost_distribution(t: Tables, scope: Scope) -> DataFrame:
    """How spend spreads over sessions: mean, exact percentiles, the costliest tenth's share."""
    tokens = sum(
        (F.col(c) for c in ("output_tokens", "cache_read_tokens", "cache_creation_tokens")),
        F.col("input_tokens"),
    )
    rows = by_period(t, scope, t.rollups("corpus")).select(
        "period", "cost_usd", tokens.alias("tokens"), "unpriced_api_calls"
    )
    ranks = distinct_ranks(rows.select("period", "cost_usd"), ["period"], "cost_usd")
    last = F.col("total") - 1

    def at(position: Column) -> Column:
        held = (F.col("below") <= position) & (position < F.col("below") + F.col("n"))
        return F.max(F.when(held, F.col("cost_usd")))

    def quantile(q: float) -> Column:
        place = last * F.lit(q)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        return money(low + (high - low) * part)

    # The percent rank of a row is its rows below over the others; ties share it.
    top = F.when(
        F.when(last > 0, F.col("below") / last).otherwise(F.lit(0.0)) >= 0.9,
        F.col("cost_usd") * F.col("n"),
    )
    spread = ranks.groupBy("period").agg(
        quantile(0.5).alias("p50_cost_usd"),
        quantile(0.9).alias("p90_cost_usd"),
        quantile(0.99).alias("p99_cost_usd"),
        money(F.sum(top) / F.nullif(F.sum(F.col("cost_usd") * F.col("n")), F.lit(0.0)))
        .alias("top_decile_share"),
    )
    totals = rows.groupBy("period").agg(
        F.count(F.lit(1)).alias("sessions"),
        money(F.sum("cost_usd")).alias("cost_usd"),
        money(F.avg("cost_usd")).alias("mean_cost_usd"),
        money(F.max("cost_usd")).alias("max_cost_usd"),
        F.sum("tokens").alias("tokens"),
        F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
    )
    return totals.join(spread, "period")


# The tools that change a file.
EDITING = ("Edit", "Write", "NotebookEdit")


def session_shapes(
    t: Tables,
    scope: Scope,
    skill_share_pct: int = 50,
    delegating_runs: int = 3,
    editing_calls: int = 5,
    busy_tool_calls: int = 5,
) -> DataFrame:
    """What kind of session each one was: an ordered ladder of stated rules, totals per shape."""
    edits = (
        t.corpus("tool_calls")
        .filter(F.col("name").isin(*EDITING))
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("edit_calls"))
    )
    loaded = (
        t.corpus("api_calls")
        .filter(F.col("attribution_skill").isNotNull())
        .groupBy("session_id", "attribution_skill")
        .agg(F.count(F.lit(1)).alias("calls"))
        .groupBy("session_id")
        .agg(F.max("calls").alias("top_skill_calls"))
    )
    edit_calls = F.coalesce("edit_calls", F.lit(0))
    share = F.coalesce("top_skill_calls", F.lit(0)) * 100 / F.nullif(F.col("api_calls"), F.lit(0))
    shape = (
        F.when((F.col("turns") == 0) & (F.col("agent_runs") == 0), "no-work")
        .when(share >= skill_share_pct, "skill-orchestrated")
        .when(F.col("agent_runs") >= delegating_runs, "delegation-heavy")
        .when(edit_calls >= editing_calls, "solo-editing")
        .when((edit_calls == 0) & (F.col("tool_calls") >= busy_tool_calls), "read-only-analysis")
        .when(F.col("tool_calls") < busy_tool_calls, "conversational")
        .otherwise("mixed")
    )
    classified = (
        t.rollups("corpus")
        .join(edits, "session_id", "left")
        .join(loaded, "session_id", "left")
        .select(
            "session_id", "turns", "tool_calls", edit_calls.alias("edit_calls"), "agent_runs",
            "compactions", "cost_usd", "unpriced_api_calls", shape.alias("shape"),
        )
    )
    counted = ("turns", "tool_calls", "edit_calls", "agent_runs", "compactions")
    return (
        by_period(t, scope, classified)
        .groupBy("period", "shape")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            *[F.sum(c).alias(c) for c in counted],
            money(F.sum("cost_usd")).alias("cost_usd"),
            money(F.avg("cost_usd")).alias("cost_usd_per_session"),
            F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
        )
    )


def thread_spend(t: Tables, family: str = "corpus") -> DataFrame:
    """One row per thread: its calls, cost, tools and errors. A run's numbers are its own thread's."""
    calls = (
        t.family(family, "api_calls")
        .groupBy("session_id", "source")
        .agg(
            F.count(F.lit(1)).alias("api_calls"),
            F.sum("cost_usd").alias("cost_usd"),
            F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
        )
    )
    tools = (
        t.family(family, "tool_calls")
        .groupBy("session_id", "source")
        .agg(
            F.count(F.lit(1)).alias("tool_calls"),
            F.count_if("is_error").alias("tool_errors"),
        )
    )
    return calls.join(tools, ["session_id", "source"], "full")


SPENT = ("api_calls", "tool_calls", "tool_errors", "unpriced_api_calls")


def runs_with_spend(t: Tables) -> DataFrame:
    spend = thread_spend(t).withColumnRenamed("source", "id")
    return (
        t.corpus("agent_runs")
        .select("session_id", "id", "agent_type", "is_fork", "started_at")
        .join(spend, ["session_id", "id"], "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in SPENT})
        .withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))
    )


def agent_types(t: Tables, scope: Scope) -> DataFrame:
    """What each agent definition is used for, and what a run of it costs."""
    per_session = (
        runs_with_spend(t)
        .groupBy("session_id", "agent_type")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if("is_fork").alias("forks"),
            *[F.sum(c).alias(c) for c in (*SPENT, "cost_usd")],
        )
    )
    runs = F.sum("runs")
    return (
        by_period(t, scope, per_session)
        .groupBy("period", "agent_type")
        .agg(
            runs.alias("runs"),
            F.count(F.lit(1)).alias("sessions"),
            F.sum("forks").alias("forks"),
            F.sum("api_calls").alias("api_calls"),
            F.sum("tool_calls").alias("tool_calls"),
            F.sum("tool_errors").alias("tool_errors"),
            F.round(F.sum("api_calls") / runs, 2).alias("api_calls_per_run"),
            money(F.sum("cost_usd")).alias("cost_usd"),
            money(F.sum("cost_usd") / runs).alias("cost_usd_per_run"),
            F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
        )
    )


def agent_compactions(t: Tables, scope: Scope) -> DataFrame:
    """Which kinds of thread run out of context, the main thread standing beside the agents."""
    compacted = (
        t.corpus("compactions")
        .groupBy("session_id", "source")
        .agg(F.count(F.lit(1)).alias("compactions"))
    )
    mains = t["sessions"].select(
        F.col("id").alias("session_id"), F.lit(MAIN).alias("source"),
        F.lit(MAIN_THREAD).alias("agent_type"),
    )
    runs = t.corpus("agent_runs").select("session_id", F.col("id").alias("source"), "agent_type")
    per_session = (
        mains.unionByName(runs)
        .join(compacted, ["session_id", "source"], "left")
        .groupBy("session_id", "agent_type")
        .agg(
            F.count(F.lit(1)).alias("threads"),
            F.count("compactions").alias("compacting_threads"),
            F.coalesce(F.sum("compactions"), F.lit(0)).alias("compactions"),
        )
    )
    return (
        by_period(t, scope, per_session)
        .groupBy("period", "agent_type")
        .agg(
            F.sum("threads").alias("threads"),
            F.sum("compacting_threads").alias("compacting_threads"),
            F.sum("compactions").alias("compactions"),
            F.round(F.sum("compactions") / F.sum("threads"), 2).alias("compactions_per_thread"),
            F.count(F.lit(1)).alias("sessions"),
        )
    )


def tool_failures(t: Tables, scope: Scope) -> DataFrame:
    per_session = (
        t.corpus("tool_calls")
        .groupBy("session_id", F.col("name").alias("tool"))
        .agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"))
    )
    return (
        by_period(t, scope, per_session)
        .groupBy("period", "tool")
        .agg(
            F.sum("calls").alias("calls"),
            F.sum("errors").alias("errors"),
            F.round(F.sum("errors") / F.sum("calls"), 4).alias("error_rate"),
            F.count(F.lit(1)).alias("sessions"),
            F.count_if(F.col("errors") > 0).alias("erring_sessions"),
        )
    )


def _evidence(
    t: Tables, scope: Scope, rows: DataFrame, keys: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Sums per group with the sessions and threads they come from, as evidence of how wide it is."""
    threads = rows.groupBy("session_id", "source", *keys).agg(
        *[c.alias(n) for n, c in sums.items()]
    )
    per_session = threads.groupBy("session_id", *keys).agg(
        F.count(F.lit(1)).alias("threads"), *[F.sum(n).alias(n) for n in sums]
    )
    return (
        by_period(t, scope, per_session)
        .groupBy("period", *keys)
        .agg(
            *[F.sum(n).alias(n) for n in sums],
            F.count(F.lit(1)).alias("sessions"),
            F.sum("threads").alias("threads"),
        )
    )


def error_signatures(
    t: Tables,
    scope: Scope,
    signature: str | None = None,
    min_occurrences: int = 5,
    signature_chars: int = SIGNATURE_CHARS,
) -> DataFrame:
    """Which errors keep happening, grouped by the masked first line of their text."""
    failed = t.corpus("tool_calls").filter("is_error")
    if signature is not None:
        failed = failed.filter(F.contains("result", F.lit(signature)))
    rows = failed.select(
        "session_id", "source", F.col("name").alias("tool"),
        F.substring(signature_line(F.col("result")), 1, signature_chars).alias("signature"),
    )
    grouped = _evidence(
        t, scope, rows, ["tool", "signature"], {"errors": F.count(F.lit(1))}
    )
    return grouped.filter(F.col("errors") >= min_occurrences)


def command_failures(
    t: Tables,
    scope: Scope,
    mentions: str | None = None,
    min_occurrences: int = 5,
    head_chars: int = COMMAND_HEAD_CHARS,
    signature_chars: int = SIGNATURE_CHARS,
) -> DataFrame:
    """Failures by the shape of the command that produced them, beside that shape's successes."""
    command = json_field(F.col("input"), "command")
    calls = t.corpus("tool_calls").select(
        "session_id", "source", F.col("name").alias("tool"), "is_error", "result",
        command.alias("command"),
    ).filter(F.col("command").isNotNull())
    if mentions is not None:
        calls = calls.filter(F.contains("command", F.lit(mentions)))
    invoked = F.col("invoked")
    rows = calls.withColumn("invoked", invocation(F.col("command"))).select(
        "session_id", "source", "tool", "is_error",
        command_head(invoked, head_chars).alias("command_head"),
        F.when(
            F.col("is_error"), F.substring(signature_line(F.col("result")), 1, signature_chars)
        ).alias("signature"),
        is_chained(invoked).alias("is_chained"),
    )
    grouped = _evidence(
        t, scope, rows, ["tool", "command_head", "signature"],
        {
            "calls": F.count(F.lit(1)),
            "chained": F.count_if("is_chained"),
            "errors": F.count_if("is_error"),
        },
    ).filter(F.col("calls") >= min_occurrences)
    heads = grouped.groupBy("period", "tool", "command_head").agg(
        F.sum("errors").alias("head_errors")
    )
    return grouped.join(heads, ["period", "tool", "command_head"]).select(
        "period", "tool", "command_head", "signature", "calls", "sessions", "threads", "chained",
        "head_errors",
    )


def path_failures(
    t: Tables, scope: Scope, min_occurrences: int = 5, tail_segments: int = 1
) -> DataFrame:
    """Which directory a failing file tool was pointed at, with that directory's successes."""
    path = json_field(F.col("input"), "file_path")
    tail = path_tail(directory_of(F.col("path")), tail_segments)
    rows = (
        t.corpus("tool_calls")
        .select("session_id", "source", "is_error", path.alias("path"))
        .filter(F.col("path").isNotNull())
        .withColumn("directory", F.when(tail == "", F.lit("(no directory)")).otherwise(tail))
    )
    threads = rows.groupBy("session_id", "source", "directory").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors")
    )
    failed = F.col("errors") > 0
    per_session = threads.groupBy("session_id", "directory").agg(
        F.sum("calls").alias("calls"),
        F.sum("errors").alias("errors"),
        F.count_if(failed).alias("threads"),
        F.sum(F.when(F.col("source") != MAIN, F.col("errors")).otherwise(F.lit(0)))
        .alias("run_errors"),
    )
    return (
        by_period(t, scope, per_session)
        .groupBy("period", "directory")
        .agg(
            F.sum("calls").alias("calls"),
            F.sum("errors").alias("errors"),
            F.count_if(failed).alias("sessions"),
            F.sum("threads").alias("threads"),
            F.sum("run_errors").alias("run_errors"),
        )
        .filter(F.col("errors") >= min_occurrences)
    )


def skill_activity(t: Tables, scope: Scope) -> DataFrame:
    """Calls made while a skill was loaded, beside how often anyone invoked it.

    An invocation whose input names no skill keeps a row of its own under a NULL name.
    """
    loaded = (
        t.corpus("api_calls")
        .filter(F.col("attribution_skill").isNotNull())
        .groupBy("session_id", F.col("attribution_skill").alias("skill"))
        .agg(
            F.count(F.lit(1)).alias("api_calls"),
            F.sum("cost_usd").alias("cost_usd"),
            F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
        )
    )
    invoked = (
        t.corpus("tool_calls")
        .filter(F.col("name") == "Skill")
        .groupBy("session_id", json_field(F.col("input"), "skill").alias("skill"))
        .agg(F.count(F.lit(1)).alias("invocations"))
    )
    a = (
        by_period(t, scope, loaded)
        .groupBy("period", "skill")
        .agg(
            F.sum("api_calls").alias("api_calls"),
            F.count(F.lit(1)).alias("sessions"),
            F.sum("cost_usd").alias("cost_usd"),
            F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
        )
    )
    i = (
        by_period(t, scope, invoked)
        .groupBy("period", "skill")
        .agg(
            F.sum("invocations").alias("invocations"),
            F.count(F.lit(1)).alias("invoking_sessions"),
        )
    )
    zero = F.lit(0)
    return a.join(i, ["period", "skill"], "full").select(
        "period", "skill",
        F.coalesce("invocations", zero).alias("invocations"),
        F.coalesce("invoking_sessions", zero).alias("invoking_sessions"),
        F.coalesce("api_calls", zero).alias("api_calls"),
        F.coalesce("sessions", zero).alias("sessions"),
        money(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"),
        F.coalesce("unpriced_api_calls", zero).alias("unpriced_api_calls"),
    )


def slash_commands(t: Tables, scope: Scope) -> DataFrame:
    """What each slash command costs to run: the calls under its turn and the tools those made.

    A tool reaches its turn through its call, matched on session and call id alone.
    """
    turn = ["session_id", "source", "turn_id"]
    calls = t.corpus("api_calls")
    spent = calls.groupBy(*turn).agg(
        F.count(F.lit(1)).alias("api_calls"),
        F.sum("cost_usd").alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
    )
    asked = (
        t.corpus("tool_calls")
        .groupBy("session_id", F.col("api_call_id").alias("call_id"))
        .agg(F.count(F.lit(1)).alias("tool_calls"))
        .join(calls.select(*turn, F.col("id").alias("call_id")), ["session_id", "call_id"])
        .groupBy(*turn)
        .agg(F.sum("tool_calls").alias("tool_calls"))
    )
    zero = F.lit(0)
    per_session = (
        t.corpus("turns")
        .filter(F.col("command_name").isNotNull())
        .select("session_id", "source", F.col("id").alias("turn_id"), "command_name")
        .join(spent, turn, "left")
        .join(asked, turn, "left")
        .groupBy("session_id", F.col("command_name").alias("command"))
        .agg(
            F.count(F.lit(1)).alias("turns"),
            F.coalesce(F.sum("api_calls"), zero).alias("api_calls"),
            F.coalesce(F.sum("tool_calls"), zero).alias("tool_calls"),
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
            F.coalesce(F.sum("unpriced_api_calls"), zero).alias("unpriced_api_calls"),
        )
    )
    return (
        by_period(t, scope, per_session)
        .groupBy("period", "command")
        .agg(
            F.sum("turns").alias("turns"),
            F.count(F.lit(1)).alias("sessions"),
            F.sum("api_calls").alias("api_calls"),
            F.sum("tool_calls").alias("tool_calls"),
            money(F.sum("cost_usd")).alias("cost_usd"),
            F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
        )
    )


def incidence(t: Tables) -> DataFrame:
    """Which tools, skills and agent types each session used, once each."""

    def used(table: str, kind: str, column: str) -> DataFrame:
        return (
            t.corpus(table)
            .filter(F.col(column).isNotNull())
            .select("session_id", F.lit(kind).alias("kind"), F.col(column).alias("item"))
            .distinct()
        )

    return (
        used("tool_calls", "tool", "name")
        .unionByName(used("api_calls", "skill", "attribution_skill"))
        .unionByName(used("agent_runs", "agent_type", "agent_type"))
    )


def co_occurrence(t: Tables, scope: Scope, min_sessions: int = 3) -> DataFrame:
    """Which items turn up in the same sessions, and how often the rarer brings the other along.

    A pair can only be frequent when both its items are, so rarer ones leave before pairs form.
    """
    held = by_period(t, scope, incidence(t))
    solo = held.groupBy("period", "kind", "item").agg(F.count(F.lit(1)).alias("sessions"))
    common = solo.filter(F.col("sessions") >= min_sessions).select("period", "kind", "item")
    kept = held.join(common, ["period", "kind", "item"], "left_semi")
    pairs = (
        kept.withColumnRenamed("item", "item_a")
        .join(kept.withColumnRenamed("item", "item_b"), ["period", "kind", "session_id"])
        .filter(F.col("item_b") > F.col("item_a"))
        .groupBy("period", "kind", "item_a", "item_b")
        .agg(F.count(F.lit(1)).alias("sessions"))
        .filter(F.col("sessions") >= min_sessions)
    )

    def alone(side: str) -> DataFrame:
        return solo.select(
            "period", "kind", F.col("item").alias(f"item_{side}"),
            F.col("sessions").alias(f"sessions_{side}"),
        )

    return (
        pairs.join(alone("a"), ["period", "kind", "item_a"])
        .join(alone("b"), ["period", "kind", "item_b"])
        .select(
            "period", "kind", "item_a", "item_b", "sessions", "sessions_a", "sessions_b",
            F.round(F.col("sessions") / F.least("sessions_a", "sessions_b"), 4)
            .alias("conditional_rate"),
        )
    )
