"""The exact numbers behind a node: where it left its window and where its dollars went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlake.functions.context import context_added, context_fill
from sessionlake.functions.pricing import context_window, split_cost
from sessionlake.functions.tools import tool_words
from sessionlake.operators.context import turns_with_fill
from sessionlake.operators.corpus import money
from sessionlake.operators.relations import Tables
from sessionlake.operators.sheets import CALL, ITEM_CHARS, named_tools
from sessionlake.operators.tree import key_of, ledger, session_key
from sessionlake.operators.windows import THREAD
from sessionlake.schema import MAIN

KINDS = ("session", "run", "turn", "call")
_TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


def _calls_of_nodes(t: Tables, kind: str) -> DataFrame:
    """Which calls a node is: a session its main thread, a run its own, a turn and a call theirs."""
    calls = t.live("api_calls")
    source, session = F.col("source"), F.col("session_id")
    if kind == "session":
        rows, key = calls.filter(source == MAIN), session_key(session)
    elif kind == "run":
        runs = t.live("agent_runs").select("session_id", F.col("id").alias("source"))
        rows, key = calls.join(runs, THREAD, "left_semi"), key_of("run", source, source)
    elif kind == "turn":
        turns = t.live("turns").select(*THREAD, F.col("id").alias("turn_id"))
        rows = calls.join(turns, [*THREAD, "turn_id"], "left_semi")
        key = key_of("turn", source, F.col("turn_id"))
    elif kind == "call":
        rows, key = calls, key_of("call", source, F.col("id"))
    else:
        raise ValueError(f"no numbers for a {kind}")
    return rows.withColumn("key", key)


def _nodes_of(t: Tables, kind: str) -> DataFrame:
    """Every node of a kind, also one that made no call of its own."""
    session, source, own = F.col("session_id"), F.col("source"), F.col("id")
    if kind == "session":
        return t.rollups("live").select("session_id", session_key(session).alias("key"))
    if kind == "run":
        return t.live("agent_runs").select("session_id", key_of("run", own, own).alias("key"))
    rows = t.live("turns" if kind == "turn" else "api_calls")
    return rows.select("session_id", key_of(kind, source, own).alias("key"))


def numbers(t: Tables, kind: str) -> DataFrame:
    """One row per node of a kind: window tip, tokens by charge, own cost and what hangs below.

    Tokens are priced per model before they are summed, and a model without a price is left out.
    """
    answered = F.when(~F.col("synthetic"), F.col("index"))
    tip = F.struct(
        "model", context_window(F.col("model")).alias("window_tokens"), "cache_read_tokens",
        (F.col("input_tokens") + F.col("cache_creation_tokens")).alias("new_input_tokens"),
        "output_tokens", context_fill().alias("fill"), context_added().alias("added"),
    )
    by_model = (
        _calls_of_nodes(t, kind)
        .groupBy("session_id", "key", "model")
        .agg(
            F.max_by(tip, answered).alias("tip"), F.max(answered).alias("tip_at"),
            *[F.sum(c).alias(c) for c in _TOKENS],
            F.sum(F.coalesce("cache_5m_tokens", "cache_creation_tokens")).alias("write_5m"),
            F.sum(F.coalesce("cache_1h_tokens", F.lit(0))).alias("write_1h"),
            F.sum("cost_usd").alias("cost_usd"),
            F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
            F.count(F.lit(1)).alias("api_calls"),
        )
        .withColumn(
            "split",
            split_cost(
                F.col("model"), F.col("input_tokens"), F.col("output_tokens"),
                F.col("cache_read_tokens"), F.col("cache_creation_tokens"), F.col("write_5m"),
                F.col("write_1h"),
            ),
        )
    )

    def usd(*members: str):
        parts = F.lit(0.0)
        for member in members:
            parts = parts + F.col(f"split.{member}")
        return F.round(F.sum(parts), 9)

    whole = by_model.groupBy("session_id", "key").agg(
        F.max_by("tip", "tip_at").alias("tip"),
        F.max_by(
            "tip.window_tokens", F.when(F.col("tip.window_tokens").isNotNull(), F.col("tip_at"))
        ).alias("window_tokens"),
        money(F.sum("cost_usd")).alias("cost_usd"),
        F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
        F.sum("api_calls").alias("api_calls"),
        usd("cache_read").alias("cache_read_usd"),
        usd("input", "cache_write").alias("new_input_usd"),
        usd("output").alias("output_usd"),
    )
    session = t.rollups("live").select("session_id", F.col("cost_usd").alias("session_usd"))
    node = ["session_id", "key"]
    rows = _nodes_of(t, kind).join(whole, node, "left").join(ledger(t), node, "left")
    rows = rows.join(session, "session_id", "left")
    added = F.lit(None).cast("long")
    if kind == "run":
        added = F.col("tip.fill")
    elif kind == "call":
        added = F.col("tip.added")
    elif kind == "turn":
        # Not held at nothing here: a turn that compacted gave window back, and says how much.
        grown = turns_with_fill(t).select(
            "session_id", key_of("turn", F.col("source"), F.col("id")).alias("key"),
            (F.col("fill") - F.coalesce("fill_before", F.lit(0))).alias("grown"),
        )
        rows = rows.join(grown, ["session_id", "key"], "left")
        added = F.col("grown")
    return rows.select(
        "session_id", "key", F.col("tip.model").alias("model"), "window_tokens",
        *[F.col(f"tip.{c}").alias(c) for c in (
            "cache_read_tokens", "new_input_tokens", "output_tokens", "fill",
        )],
        added.alias("added"), "cost_usd",
        F.coalesce("under_usd", F.lit(0.0)).alias("subtree_usd"), "session_usd",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("unpriced_api_calls", "api_calls")],
        # Nothing was spent where nothing was asked; a model without a price stays unknown.
        *[
            F.when(F.col("api_calls").isNull(), F.lit(0.0)).otherwise(F.col(c)).alias(c)
            for c in ("cache_read_usd", "new_input_usd", "output_usd")
        ],
    )


def compaction_numbers(t: Tables, chip_chars: int = 40) -> DataFrame:
    return t.live("compactions").select(
        *THREAD, F.col("id").alias("compaction_id"), "pre_tokens", "post_tokens",
        (F.col("pre_tokens") - F.col("post_tokens")).alias("freed"),
        F.substring("trigger", 1, chip_chars).alias("trigger"),
    )


def tool_numbers(t: Tables, head_items: int = 3, item_chars: int = ITEM_CHARS) -> DataFrame:
    """A tool call's sizes and the tools its call made beside it.

    The first few tools of a call and one more are gathered once per call; a tool's neighbours are
    those without itself, so a call with many tools never meets itself pair by pair.
    """
    tools = named_tools(t, item_chars).withColumn(
        "title", F.concat_ws(" ", "name", tool_words(F.col("name"), F.col("fields")))
    )
    nth = F.row_number().over(Window.partitionBy(*CALL).orderBy("index"))
    first = (
        tools.select(*CALL, "index", "id", "title")
        .withColumn("nth", nth)
        .filter(F.col("nth") <= head_items + 1)
        .groupBy(*CALL)
        .agg(F.sort_array(F.collect_list(F.struct("index", "id", "title"))).alias("beside"))
    )
    total = tools.groupBy(*CALL).agg(F.count(F.lit(1)).alias("made"))
    spawned = t.live("agent_runs").filter(F.col("tool_use_id").isNotNull()).select(
        "session_id", F.col("tool_use_id").alias("id"), F.lit(True).alias("spawned_run")
    ).distinct()
    others = F.filter("beside", lambda b: b["id"] != F.col("id"))
    return (
        tools.join(first, CALL)
        .join(total, CALL)
        .join(spawned, ["session_id", "id"], "left")
        .select(
            *THREAD, F.col("id").alias("tool_call_id"), F.length("result").alias("result_chars"),
            F.length("input").alias("input_chars"), "offload_file",
            F.transform(F.slice(others, 1, head_items), lambda b: b["title"]).alias("siblings"),
            F.greatest(F.col("made") - 1 - head_items, F.lit(0)).cast("int")
            .alias("siblings_cut"),
            F.coalesce("spawned_run", F.lit(False)).alias("spawned_run"),
        )
    )
