"""Context windows over a thread: turns that fill it, compactions that empty it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.context import (
    bar_step,
    context_added,
    context_fill,
    opening_context,
)
from sessionlake.functions.pricing import context_window
from sessionlake.functions.text import cut
from sessionlake.operators.corpus import money
from sessionlake.operators.relations import Tables
from sessionlake.operators.sheets import (
    CALL,
    NAV_CHARS,
    TURN,
    call_tools_tally,
    context_tips,
    named_tools,
    own_turn,
)
from sessionlake.operators.windows import THREAD, block_of, blocks_holding, covering, running
from sessionlake.schema import MAIN


def turns_with_fill(t: Tables) -> DataFrame:
    """Turns with where they left their thread's window and where the answered turn before had."""
    tips = context_tips(t, TURN).withColumnRenamed("turn_id", "id")
    turns = (
        t.live("turns")
        .join(tips, [*THREAD, "id"], "left")
        .withColumns({"fill": F.col("tip.fill"), "window": F.col("tip.window")})
        .drop("tip")
    )
    return running(
        turns, THREAD, block_of(F.col("index")), ["index"],
        lasts={"fill_before": F.col("fill")}, strict=True,
    )


def session_openings(t: Tables) -> DataFrame:
    """What a session's main thread sent before a word was said."""
    return (
        t.live("api_calls")
        .filter((F.col("source") == MAIN) & ~F.col("synthetic"))
        .groupBy("session_id")
        .agg(F.min_by(opening_context(), "index").alias("base"))
    )


def turn_bars(t: Tables, nav_chars: int = NAV_CHARS) -> DataFrame:
    """A thread's turns in outline: title parts, cost, and the context bar.

    Growth is measured against the last turn that answered and never drawn below nothing.
    """
    spend = t.live("api_calls").groupBy(*TURN).agg(
        money(F.sum("cost_usd")).alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
    ).withColumnRenamed("turn_id", "id")
    grown = F.when(
        F.col("fill").isNotNull(),
        F.greatest(F.col("fill") - F.coalesce("fill_before", F.lit(0)), F.lit(0)),
    )
    # With nothing to compare, the larger of an unknown and zero is zero.
    added = F.coalesce(grown, F.lit(0).cast("long"))
    return (
        turns_with_fill(t)
        .join(spend, [*THREAD, "id"], "left")
        .join(session_openings(t), "session_id", "left")
        .select(
            *THREAD, F.col("index").alias("turn_index"), F.col("id").alias("turn_id"),
            *[cut(F.col(c), nav_chars).alias(c)
              for c in ("prompt", "command_name", "command_args")],
            "started_at", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
            F.coalesce("unpriced_api_calls", F.lit(0)).alias("unpriced_api_calls"),
            F.struct("fill", added.alias("added"), "base", "window").alias("context"),
        )
    )


def call_rows(t: Tables, nav_chars: int = NAV_CHARS) -> DataFrame:
    """A thread's calls in outline, each under the turn of its own thread it answers."""
    calls = own_turn(t, t.live("api_calls")).withColumnRenamed("id", "api_call_id")
    context = F.when(
        ~F.col("synthetic"),
        F.struct(
            context_fill().alias("fill"), context_added().alias("added"),
            context_window(F.col("model")).alias("window"),
        ),
    )
    return calls.join(call_tools_tally(t, nav_chars), CALL, "left").select(
        *THREAD, "turn_id", F.col("index").alias("call_index"), "api_call_id",
        cut(F.col("text"), nav_chars).alias("text"), cut(F.col("model"), nav_chars).alias("model"),
        "first", "tally", context.alias("context"), "started_at",
        money(F.col("cost_usd")).alias("cost_usd"),
        F.col("cost_usd").isNull().cast("int").alias("unpriced_api_calls"),
    )


def tool_rows(t: Tables, nav_chars: int = NAV_CHARS) -> DataFrame:
    """A thread's tool calls in outline, with what the call holding them cost."""
    calls = own_turn(t, t.live("api_calls")).select(
        *THREAD, F.col("id").alias("api_call_id"), "turn_id",
        F.col("index").alias("call_index"), money(F.col("cost_usd")).alias("call_cost_usd"),
        F.col("cost_usd").isNull().cast("int").alias("unpriced_api_calls"),
    )
    tools = named_tools(t, nav_chars).select(
        *CALL, F.col("index").alias("tool_index"), F.col("id").alias("tool_call_id"),
        cut(F.col("name"), nav_chars).alias("name"), "fields", "started_at", "is_error",
    )
    return tools.join(calls, CALL)


def compaction_turns(t: Tables) -> DataFrame:
    """The turn each compaction fell in: the one started last of those running at that instant.

    A turn is laid over blocks of hours, each twice the size of the one below, so that a few dozen
    cover it however long it ran, and a compaction meets on equality the turns that cover its hour.
    """
    hour = lambda c: F.floor(F.unix_seconds(c) / 3600).cast("long")
    turns = t.live("turns").select(
        *THREAD, F.col("id").alias("turn_id"), "index", "started_at", "ended_at",
        F.inline(covering(hour("started_at"), hour(F.greatest("ended_at", "started_at")))),
    )
    marks = t.live("compactions").select(*THREAD, "id", "timestamp", F.inline(blocks_holding(hour("timestamp"))))
    return (
        marks.join(turns, [*THREAD, "level", "block"])
        .filter(
            (F.col("timestamp") >= F.col("started_at")) & (F.col("timestamp") < F.col("ended_at"))
        )
        .groupBy(*THREAD, "id")
        .agg(F.max_by("turn_id", F.struct("started_at", "index")).alias("turn_id"))
    )


def compaction_models(t: Tables) -> DataFrame:
    """The model in force at each compaction: the last call at or before it, else the first after."""
    calls = t.live("api_calls").filter(~F.col("synthetic")).select(
        *THREAD, "id", F.col("started_at").alias("at"), F.lit(0).alias("mark"),
        F.col("index").alias("nth"), "model",
    )
    marks = t.live("compactions").select(
        *THREAD, "id", F.col("timestamp").alias("at"), F.lit(1).alias("mark"),
        F.lit(0).alias("nth"), F.lit(None).cast("string").alias("model"),
    )
    before = running(
        calls.unionByName(marks), THREAD, F.to_date("at"), ["at", "mark", "nth", "id"],
        lasts={"model_before": F.col("model")},
    ).filter(F.col("mark") == 1)
    # Nothing before a compaction means the first call after it is the thread's first.
    first = calls.groupBy(*THREAD).agg(
        F.min_by("model", F.struct("at", "nth")).alias("first_model")
    )
    return before.join(first, THREAD, "left").select(
        *THREAD, "id", F.coalesce("model_before", "first_model").alias("model")
    )


def compactions(t: Tables, chip_chars: int = 40) -> DataFrame:
    """Every compaction in its turn, with the span of window it gave back."""
    key = [*THREAD, "id"]
    return (
        t.live("compactions")
        .join(compaction_turns(t), key, "left")
        .join(compaction_models(t), key, "left")
        .select(
            *THREAD, F.col("id").alias("compaction_id"), "timestamp", "turn_id",
            F.substring("trigger", 1, chip_chars).alias("trigger"), "pre_tokens", "post_tokens",
            "duration_ms",
            F.struct(
                F.col("pre_tokens").alias("fill"),
                (F.col("pre_tokens") - F.col("post_tokens")).alias("added"),
                context_window(F.col("model")).alias("window"),
            ).alias("context"),
        )
    )


def bands(context: Column, with_base: bool = False) -> Column:
    """A context as nested steps of a bar: how full, where its own share begins, what it opened on."""
    window = context["window"]
    fill = bar_step(context["fill"], window)
    base = (
        F.when(context["base"] > 0, F.least(bar_step(context["base"], window), fill))
        if with_base
        else F.lit(None).cast("int")
    )
    stood = F.greatest(context["fill"] - context["added"], F.lit(0))
    prior = F.greatest(F.least(bar_step(stood, window), fill), F.coalesce(base, F.lit(0)))
    drawn = window.isNotNull() & context["fill"].isNotNull()
    return F.when(
        drawn,
        F.struct(
            fill.alias("fill"), F.when(context["added"].isNotNull(), prior).alias("prior"),
            base.alias("base"),
        ),
    )


def turn_bands(t: Tables) -> DataFrame:
    bars = turn_bars(t)
    return bars.select(*THREAD, "turn_id", bands(F.col("context"), with_base=True).alias("band"))
