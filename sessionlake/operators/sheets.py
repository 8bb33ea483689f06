"""What a reader opens: sessions, threads, turns, calls, tools, runs, records, values.

Each relation is computed for every session at once; reading one page is a filter on its key
columns, which Spark pushes down to the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlake.functions.context import context_added, context_fill
from sessionlake.functions.pricing import context_window
from sessionlake.functions.text import collapse, cut, file_suffix
from sessionlake.functions.times import millis_between
from sessionlake.functions.tools import json_field, members, told, tool_fields
from sessionlake.operators.corpus import money, thread_spend
from sessionlake.operators.listing import first_names
from sessionlake.operators.relations import (
    Tables,
    enriched_agent_runs,
    enriched_sessions,
    enriched_turns,
)
from sessionlake.operators.containment import last_lines_with
from sessionlake.operators.windows import THREAD, running
from sessionlake.schema import MAIN

HEAD_CHARS = 100
DETAIL_CHARS = 2000
LOG_CHARS = 80
NAV_CHARS = 60
CHIP_CHARS = 40
ITEM_CHARS = 40
HEAD_ITEMS = 3
UNATTRIBUTED = "(unattributed)"
TURN = [*THREAD, "turn_id"]
CALL = [*THREAD, "api_call_id"]


def _priced(rows: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("api_calls"),
        F.sum("cost_usd").alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
        *extra,
    )


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(n, F.lit(0)).alias(n) for n in names]


def _cost() -> Column:
    return money(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd")


def own_turn(t: Tables, calls: DataFrame) -> DataFrame:
    """Calls with the turn of their own thread they answer; a turn of another thread is none."""
    turns = t.live("turns").select(
        *THREAD, F.col("id").alias("turn_id"), F.lit(True).alias("_held")
    )
    return calls.join(turns, TURN, "left").withColumn(
        "turn_id", F.when(F.col("_held"), F.col("turn_id"))
    ).drop("_held")


def named_tools(t: Tables, chars: int, tools: DataFrame | None = None) -> DataFrame:
    """Tool calls, all live ones if none are given, with the fields their names are made from."""
    sessions = t["sessions"].select(F.col("id").alias("session_id"), "project_dir")
    runs = t.live("agent_runs").select(
        "session_id", F.col("id").alias("_to"), F.col("agent_type").alias("_addressed")
    )
    return (
        (t.live("tool_calls") if tools is None else tools)
        .withColumn("_asked", members(F.col("input")))
        .withColumn("_told", told(F.col("_asked"), chars))
        .withColumn("_to", F.col("_told.to"))
        .drop("_asked")
        .join(sessions, "session_id", "left")
        .join(runs, ["session_id", "_to"], "left")
        .withColumn(
            "fields", tool_fields(F.col("_told"), F.col("project_dir"), F.col("_addressed"), chars)
        )
        .drop("_to", "_told", "_addressed", "project_dir")
    )


def session_overview(t: Tables) -> DataFrame:
    """The headline numbers of each session and the stamp of the read that produced them."""
    errors = t.live("tool_calls").filter("is_error").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("tool_errors")
    )

    def names(table: str, column: str, alias: str) -> DataFrame:
        used = t.live(table).select("session_id", column).filter(F.col(column).isNotNull())
        return used.distinct().groupBy("session_id").agg(
            F.array_join(F.sort_array(F.collect_list(column)), " ").alias(alias)
        )

    state = t["extract_state"].select(
        "session_id", F.col("fingerprint").alias("extract_fingerprint"), "extractor_version"
    )
    return (
        t.rollups("live")
        .join(errors, "session_id", "left")
        .join(names("api_calls", "attribution_skill", "skills"), "session_id", "left")
        .join(names("turns", "command_name", "commands"), "session_id", "left")
        .join(state, "session_id", "left")
        .select(
            "session_id", "started_at", "turns", "api_calls", "tool_calls",
            *_zero("tool_errors"), "agent_runs", "compactions", _cost(), "unpriced_api_calls",
            "skills", "commands", "extract_fingerprint", "extractor_version",
        )
    )


def timeline(t: Tables, log_chars: int = LOG_CHARS) -> DataFrame:
    """Every thread a row per turn, and a row for the calls that answer no turn of the thread."""
    calls = t.live("api_calls")
    spend = _priced(calls, TURN, F.min("started_at").alias("first_call"))
    made = calls.select(*TURN, F.col("id").alias("api_call_id"))
    tools = (
        t.live("tool_calls")
        .groupBy(*CALL)
        .agg(F.count(F.lit(1)).alias("tool_calls"), F.count_if("is_error").alias("tool_errors"))
        .join(made, CALL)
        .groupBy(*TURN)
        .agg(F.sum("tool_calls").alias("tool_calls"), F.sum("tool_errors").alias("tool_errors"))
    )
    # One row per (thread, turn or none): null-safe, so the calls under no turn keep their tools.
    left, right = spend.alias("s"), tools.alias("l")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in TURN]
    spent = left.join(right, same, "left").select("s.*", "l.tool_calls", "l.tool_errors")
    turns = t.live("turns").select(
        *THREAD, F.col("id").alias("turn_id"), F.col("index").alias("turn_index"), "prompt",
        "command_name", "command_args", "started_at", F.lit(True).alias("_turn"),
    )
    return turns.join(spent, TURN, "full").select(
        *THREAD, "turn_index",
        F.when(F.col("_turn"), F.col("turn_id")).otherwise(F.lit(UNATTRIBUTED)).alias("turn_id"),
        *[cut(F.col(c), log_chars).alias(c) for c in ("prompt", "command_name", "command_args")],
        F.coalesce("started_at", "first_call").alias("started_at"),
        *_zero("api_calls", "tool_calls", "tool_errors"), _cost(), *_zero("unpriced_api_calls"),
    )


def error_records(t: Tables, max_chars: int = 200) -> DataFrame:
    """Failed calls and the last transcript line that holds the id of each, whatever the id is made of."""
    failed = t.live("tool_calls").filter("is_error").select(
        *THREAD, F.col("id").alias("tool_call_id"), F.col("name").alias("tool"), "started_at",
        F.length("result").alias("error_chars"),
        F.substring(collapse(F.col("result")), 1, max_chars).alias("error"),
    )
    lines = last_lines_with(t["raw_records"], failed.select(*THREAD, F.col("tool_call_id").alias("words")).distinct())
    found = lines.withColumnRenamed("words", "tool_call_id")
    return failed.join(found, [*THREAD, "tool_call_id"], "left").select(
        *THREAD, "line_no", "tool", "tool_call_id", "started_at", "error_chars", "error"
    )


def records_slice(t: Tables, first_line: int, last_line: int, max_chars: int = 400) -> DataFrame:
    return t["raw_records"].filter(F.col("line_no").between(first_line, last_line)).select(
        *THREAD, "line_no", "type", "timestamp", F.length("raw").alias("raw_chars"),
        F.substring("raw", 1, max_chars).alias("raw"),
    )


def _page(rows: DataFrame, keys: list[str], order: str, size: int, skipped: int = 0) -> DataFrame:
    """One page per key and how many rows match in all, counted before the page is cut."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    cut_rows = rows.withColumn("_nth", nth).filter(F.col("_nth") <= skipped + size)
    if skipped:
        cut_rows = cut_rows.filter(F.col("_nth") > skipped)
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched_rows"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return (
        cut_rows.drop("_nth").alias("p")
        .join(total.alias("n"), same)
        .select("p.*", "n.matched_rows")
    )


def records_page(
    t: Tables, after: int = 0, page_records: int = 50, preview_chars: int = 200
) -> DataFrame:
    """The next page of each thread's records past a line."""
    rows = t["raw_records"].filter(F.col("line_no") > after).select(
        *THREAD, "line_no", "uuid", "type", "timestamp", F.length("raw").alias("raw_chars"),
        F.substring("raw", 1, preview_chars).alias("raw_head"),
    )
    return _page(rows, THREAD, "line_no", page_records)


def record(t: Tables, line_no: int) -> DataFrame:
    return t["raw_records"].filter(F.col("line_no") == line_no).select(
        *THREAD, "line_no", "uuid", "type", "timestamp", F.length("raw").alias("raw_chars"), "raw"
    )


_DIGEST = (
    "description", "category", "outcome", "friction", "enrichment_model", "prompt_version",
    "taxonomy_version", "enriched_at",
)


def enrichment_digest(t: Tables, level: str | None = None) -> DataFrame:
    """What was said of each session, main turn and run; an item nobody described keeps its row."""
    none = F.lit(None).cast("string")
    nowhere = F.lit(None).cast("int")
    turns = enriched_turns(t).filter(F.col("source") == MAIN).select(
        "session_id", F.lit("turn").alias("level"), "source", F.col("id").alias("item_id"),
        F.col("index").alias("item_index"), F.col("command_name").alias("label"), "started_at",
        *_DIGEST,
    )
    runs = enriched_agent_runs(t).select(
        "session_id", F.lit("agent_run").alias("level"), F.col("id").alias("source"),
        F.col("id").alias("item_id"), nowhere.alias("item_index"),
        F.col("agent_type").alias("label"), "started_at", *_DIGEST,
    )
    whole = enriched_sessions(t).select(
        "session_id", F.lit("session").alias("level"), none.alias("source"),
        none.alias("item_id"), nowhere.alias("item_index"), none.alias("label"), "started_at",
        *_DIGEST,
    )
    rows = turns.unionByName(runs).unionByName(whole)
    return rows if level is None else rows.filter(F.col("level") == level)


def enrichment_rows(
    t: Tables, description_chars: int = 200, tag_chars: int = 20, head_chars: int = HEAD_CHARS
) -> DataFrame:
    """The rows a description pass wrote, cut to what a page shows, with their whole lengths."""

    def said(table: str, level: str, source: Column, item: str) -> DataFrame:
        return t[table].select(
            "session_id", F.lit(level).alias("level"), source.alias("source"),
            F.col(item).alias("item_id"),
            cut(F.col("description"), description_chars).alias("description"),
            F.substring("category", 1, tag_chars).alias("category"),
            F.substring("outcome", 1, tag_chars).alias("outcome"),
            cut(F.col("friction"), description_chars).alias("friction"),
            F.length("description").alias("description_chars"),
            F.length("friction").alias("friction_chars"),
            F.substring("model", 1, head_chars).alias("model"), "enriched_at", "prompt_version",
            "taxonomy_version",
        )

    none = F.lit(None).cast("string")
    return (
        said("turn_enrichments", "turn", F.col("source"), "turn_id")
        .unionByName(said("agent_run_enrichments", "agent_run", none, "agent_run_id"))
        .unionByName(said("session_enrichments", "session", none, "session_id"))
    )


def context_tips(t: Tables, keys: list[str], position: str = "index") -> DataFrame:
    """Where the last answered call of each group left the window. Synthetic replies say nothing."""
    answered = t.live("api_calls").filter(~F.col("synthetic")).select(
        *keys, position, context_fill().alias("fill"), context_added().alias("added"),
        context_window(F.col("model")).alias("window"),
    )
    # The window is the last one known: a model without one leaves the scale as it stood.
    known = F.when(F.col("window").isNotNull(), F.col(position))
    return (
        answered.groupBy(*keys)
        .agg(
            F.max_by("fill", position).alias("fill"), F.max_by("added", position).alias("added"),
            F.max_by("window", known).alias("window"),
        )
        .select(*keys, F.struct("fill", "added", "window").alias("tip"))
    )


def session_header(
    t: Tables, head_chars: int = HEAD_CHARS, head_items: int = HEAD_ITEMS,
    item_chars: int = ITEM_CHARS,
) -> DataFrame:
    tips = context_tips(t, THREAD).filter(F.col("source") == MAIN).select("session_id", "tip")
    errors = t.live("tool_calls").filter("is_error").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("tool_errors")
    )
    key = ["session_id"]
    skills = first_names(
        t.live("api_calls"), key, "attribution_skill", "skills", head_items, item_chars
    )
    links = first_names(t["pr_links"], key, "pr_url", "pr_urls", head_items, item_chars)
    facts = t["sessions"].select(
        F.col("id").alias("session_id"), "git_branch", "version", "entrypoint"
    )
    place = F.col("project_dir")
    none = F.array().cast("array<string>")
    return (
        t.rollups("live")
        .join(facts, key)
        .join(errors, key, "left")
        .join(skills, key, "left")
        .join(links, key, "left")
        .join(tips, key, "left")
        .select(
            "session_id", cut(F.col("title"), head_chars).alias("title"),
            cut(place, head_chars).alias("project_dir"),
            F.when(F.length(place) <= head_chars, place).alias("project_filter"),
            *[cut(F.col(c), head_chars).alias(c) for c in ("git_branch", "version", "entrypoint")],
            "started_at", "ended_at", "wall_ms", "active_ms", "turns", "api_calls", "tool_calls",
            "agent_runs", "compactions", *_zero("tool_errors"), _cost(), "unpriced_api_calls",
            "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens",
            F.coalesce("skills", none).alias("skills"), *_zero("skills_cut"),
            F.coalesce("pr_urls", none).alias("pr_urls"), *_zero("pr_urls_cut"),
            F.struct(
                F.col("tip.fill").alias("fill"), F.lit(None).cast("long").alias("added"),
                F.col("tip.window").alias("window"),
            ).alias("context"),
        )
    )


def turn_headers(
    t: Tables, detail_chars: int = DETAIL_CHARS, head_chars: int = HEAD_CHARS
) -> DataFrame:
    calls = t.live("api_calls").filter(F.col("turn_id").isNotNull())
    tools = (
        t.live("tool_calls")
        .join(calls.select(*TURN, F.col("id").alias("api_call_id")), CALL)
        .groupBy(*TURN)
        .agg(F.count(F.lit(1)).alias("tool_calls"), F.count_if("is_error").alias("tool_errors"))
    )
    plain = F.col("command_name").isNull()
    return (
        t.live("turns")
        .withColumnRenamed("id", "turn_id")
        .join(_priced(calls, TURN), TURN, "left")
        .join(tools, TURN, "left")
        .select(
            *THREAD, F.col("index").alias("turn_index"), "turn_id",
            F.when(plain, cut(F.col("prompt"), detail_chars)).alias("prompt"),
            F.when(plain, F.length("prompt")).alias("prompt_chars"),
            cut(F.col("command_name"), head_chars).alias("command_name"),
            cut(F.col("command_args"), detail_chars).alias("command_args"),
            F.length("command_args").alias("command_args_chars"), "started_at", "ended_at",
            "replayed", *_zero("api_calls", "tool_calls", "tool_errors"), _cost(),
            *_zero("unpriced_api_calls"),
        )
    )


def call_tools_tally(t: Tables, chars: int) -> DataFrame:
    """What each call went on to do: its first tool, and its tools' names with how often, in order."""
    return tools_tally(named_tools(t, chars, repeated_tools(t)), ["fields"])


def repeated_tools(t: Tables) -> DataFrame:
    """Live tool calls, each with how many times (`nth`) its call had used a tool of its name by then."""
    order = Window.partitionBy(*CALL, "name").orderBy("index")
    return t.live("tool_calls").withColumn("nth", F.row_number().over(order))


def tools_tally(tools: DataFrame, told: list[str]) -> DataFrame:
    """The tally of each call's tools, which have their `nth`; the first is told by name and `told`.

    A tally rather than a list of every call: names are few however many tools one call made.
    """
    # Where a name comes up again, which is its place once the call's first tool is set aside.
    again = F.min(F.when((F.col("nth") == 2) & F.col("name").isNotNull(), F.col("index")))
    names = tools.groupBy(*CALL, "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("index").alias("at"),
        F.min_by(F.struct("name", *told), "index").alias("tool"), again.alias("again"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("at", "name", "n", "again")))
    held = names.groupBy(*CALL).agg(
        F.sum("n").alias("tool_calls"), F.min_by("tool", "at").alias("first"),
        ordered.alias("_held"),
    )
    others = F.transform(
        "_held",
        lambda k, i: F.struct(
            F.when(i == 0, k["again"]).otherwise(k["at"]).alias("at"), k["name"].alias("name"),
            (k["n"] - F.when(i == 0, 1).otherwise(0)).alias("n"),
        ),
    )

    def named(held: Column) -> Column:
        return F.transform(held, lambda k: F.struct(k["name"].alias("name"), k["n"].alias("n")))

    return held.select(
        *CALL, "tool_calls", "first", named(F.col("_held")).alias("tally"),
        named(F.sort_array(F.filter(others, lambda k: k["n"] > 0))).alias("rest"),
    )


def _call_columns(chars: int) -> list[Column]:
    return [
        F.col("index").alias("call_index"), F.col("api_call_id"),
        cut(F.col("model"), chars).alias("model"), "effort", "stop_reason", "attribution_skill",
        "started_at", "input_tokens", "output_tokens", "cache_read_tokens",
        "cache_creation_tokens", money(F.col("cost_usd")).alias("cost_usd"),
        F.col("cost_usd").isNull().cast("int").alias("unpriced_api_calls"),
        F.length("text").alias("text_chars"), F.length("thinking").alias("thinking_chars"),
        *_zero("tool_calls"),
    ]


def call_headers(
    t: Tables, head_chars: int = HEAD_CHARS, detail_chars: int = DETAIL_CHARS
) -> DataFrame:
    calls = own_turn(t, t.live("api_calls")).withColumnRenamed("id", "api_call_id")
    return calls.join(call_tools_tally(t, head_chars), CALL, "left").select(
        *THREAD, "turn_id", *_call_columns(head_chars),
        cut(F.col("fallback_from"), head_chars).alias("fallback_from"),
        cut(F.col("text"), detail_chars).alias("text"),
        cut(F.col("thinking"), detail_chars).alias("thinking"), "first", "tally",
    )


def tool_headers(
    t: Tables, head_chars: int = HEAD_CHARS, detail_chars: int = DETAIL_CHARS
) -> DataFrame:
    tools = named_tools(t, head_chars).withColumnRenamed("id", "tool_call_id")
    calls = own_turn(t, t.live("api_calls")).select(
        *THREAD, "turn_id", F.col("id").alias("api_call_id")
    )
    spawned = t.live("agent_runs").select(
        "session_id", F.col("tool_use_id").alias("tool_call_id"), F.col("id").alias("run_id")
    ).filter(F.col("tool_call_id").isNotNull())
    command = F.when(F.col("name") == "Bash", json_field(F.col("input"), "command"))
    suffix = F.when(
        F.col("name") == "Read",
        F.substring(file_suffix(json_field(F.col("input"), "file_path")), 1, head_chars),
    )
    held = tools.join(calls, CALL)
    own_copy = F.col("t.source") == F.col("a.run_id")
    joined = held.alias("t").join(
        spawned.alias("a"),
        (F.col("t.session_id") == F.col("a.session_id"))
        & (F.col("t.tool_call_id") == F.col("a.tool_call_id"))
        & ~own_copy,
        "left",
    )
    return joined.select("t.*", "a.run_id").select(
        *THREAD, F.col("index").alias("tool_index"), "tool_call_id", "api_call_id", "turn_id",
        cut(F.col("name"), head_chars).alias("name"), "fields", "server_side", "is_error",
        "incomplete", "offload_file", "run_id", "started_at", "ended_at",
        millis_between(F.col("started_at"), F.col("ended_at")).alias("wall_ms"),
        cut(F.col("input"), detail_chars).alias("input"), F.length("input").alias("input_chars"),
        cut(F.col("result"), detail_chars).alias("result"),
        F.length("result").alias("result_chars"),
        cut(command, detail_chars).alias("command"), F.length(command).alias("command_chars"),
        suffix.alias("result_type"),
    )


def spawn_edges(t: Tables) -> DataFrame:
    """Where each run hangs: the tool call that asked for it, that call's thread, call and turn.

    A run's own transcript may hold a copy of the call that spawned it; that copy never counts.
    """
    tools = t.live("tool_calls").select(
        "session_id", F.col("source").alias("spawn_source"), F.col("id").alias("tool_use_id"),
        F.col("api_call_id").alias("spawn_call_id"),
    )
    runs = t.live("agent_runs").select("session_id", F.col("id").alias("run_id"), "tool_use_id")
    asked = runs.join(tools, ["session_id", "tool_use_id"]).filter(
        F.col("spawn_source") != F.col("run_id")
    )
    calls = t.live("api_calls").select(
        "session_id", F.col("source").alias("spawn_source"), F.col("id").alias("spawn_call_id"),
        "turn_id",
    )
    # Turns are looked up for the few calls that asked for a run, not for all.
    asking = asked.join(calls, ["session_id", "spawn_source", "spawn_call_id"]).drop("tool_use_id")
    placed = (
        own_turn(t, asking.withColumnRenamed("spawn_source", "source"))
        .withColumnsRenamed({"source": "spawn_source", "turn_id": "spawn_turn_id"})
    )
    return (
        runs.join(placed, ["session_id", "run_id"], "left")
        .select(
            "session_id", "run_id", "tool_use_id", "spawn_source", "spawn_call_id",
            "spawn_turn_id",
        )
    )


def run_list(t: Tables, chip_chars: int = CHIP_CHARS) -> DataFrame:
    """Every run with its spawn edge, what its own thread spent, and where it left its window."""
    calls = _priced(t.live("api_calls"), THREAD).withColumn("cost_usd", money(F.col("cost_usd")))
    errors = t.live("tool_calls").groupBy(*THREAD).agg(F.count_if("is_error").alias("tool_errors"))
    compacted = t.live("compactions").groupBy(*THREAD).agg(
        F.count(F.lit(1)).alias("compactions")
    )
    rows = t.live("agent_runs").withColumn("source", F.col("id"))
    for measure in (calls, errors, compacted, context_tips(t, THREAD)):
        rows = rows.join(measure, THREAD, "left")
    edges = spawn_edges(t).drop("tool_use_id").withColumnRenamed("run_id", "id")
    return rows.join(edges, ["session_id", "id"], "left").select(
        "session_id", F.col("id").alias("run_id"),
        *[cut(F.col(c), chip_chars).alias(c) for c in ("agent_type", "brief", "model")],
        "spawn_depth", "is_fork", "parent_agent_id", "tool_use_id", "started_at", "ended_at",
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        *_zero("unpriced_api_calls", "tool_errors", "compactions"),
        F.struct(
            F.col("tip.fill").alias("fill"), F.col("tip.fill").alias("added"),
            F.col("tip.window").alias("window"),
        ).alias("context"),
        "spawn_source", "spawn_turn_id", "spawn_call_id",
    )


def _asking(t: Tables) -> DataFrame:
    """The call that spawned each run, as it was recorded on the thread that asked."""
    tools = t.live("tool_calls").select(
        "session_id", F.col("source").alias("_at"), F.col("id").alias("tool_use_id"), "input",
        "result",
    )
    runs = t.live("agent_runs").select("session_id", F.col("id").alias("run_id"), "tool_use_id")
    return runs.join(tools, ["session_id", "tool_use_id"]).filter(
        F.col("_at") != F.col("run_id")
    ).select(
        "session_id", "run_id", json_field(F.col("input"), "prompt").alias("prompt"), "result"
    )


def run_headers(
    t: Tables, head_chars: int = HEAD_CHARS, detail_chars: int = DETAIL_CHARS
) -> DataFrame:
    spend = thread_spend(t, "live").withColumnRenamed("source", "run_id")
    written = t.live("api_calls").groupBy("session_id", F.col("source").alias("run_id")).agg(
        F.sum("output_tokens").alias("output_tokens")
    )

    def counted(table: str) -> DataFrame:
        return t.live(table).groupBy("session_id", F.col("source").alias("run_id")).agg(
            F.count(F.lit(1)).alias(table)
        )

    rows = t.live("agent_runs").withColumnRenamed("id", "run_id")
    for part in (_asking(t), spend, written, counted("turns"), counted("compactions")):
        rows = rows.join(part, ["session_id", "run_id"], "left")
    return rows.select(
        "session_id", "run_id", cut(F.col("agent_type"), head_chars).alias("agent_type"),
        cut(F.col("brief"), detail_chars).alias("brief"), F.length("brief").alias("brief_chars"),
        cut(F.col("model"), head_chars).alias("model"),
        cut(F.col("prompt"), detail_chars).alias("prompt"),
        F.length("prompt").alias("prompt_chars"),
        cut(F.col("result"), detail_chars).alias("result"),
        F.length("result").alias("result_chars"), "spawn_depth", "is_fork", "parent_agent_id",
        "tool_use_id", "started_at", "ended_at",
        millis_between(F.col("started_at"), F.col("ended_at")).alias("wall_ms"),
        *_zero("turns", "api_calls", "tool_calls", "tool_errors", "compactions", "output_tokens"),
        _cost(), *_zero("unpriced_api_calls"),
    )


def turn_calls(
    t: Tables, page_calls: int = 25, skipped: int = 0, log_chars: int = LOG_CHARS
) -> DataFrame:
    """A page of the calls under every turn, and under no turn of their thread."""
    calls = own_turn(t, t.live("api_calls")).withColumnRenamed("id", "api_call_id")
    page = _page(calls, TURN, "index", page_calls, skipped)
    return page.join(call_tools_tally(t, log_chars), CALL, "left").select(
        *THREAD, "turn_id", *_call_columns(log_chars), cut(F.col("text"), log_chars).alias("text"),
        F.substring("fallback_from", 1, log_chars).alias("fallback_from"), "tally",
        "matched_rows",
    )


def call_tools(
    t: Tables, page_tools: int = 25, skipped: int = 0, log_chars: int = LOG_CHARS
) -> DataFrame:
    """A page of the tools every call made."""
    return _page(named_tools(t, log_chars), CALL, "index", page_tools, skipped).select(
        *CALL, F.col("index").alias("tool_index"), F.col("id").alias("tool_call_id"),
        cut(F.col("name"), log_chars).alias("name"), "server_side", "is_error", "incomplete",
        "offload_file", "started_at", F.length("input").alias("input_chars"),
        F.length("result").alias("result_chars"), "matched_rows", "fields",
    )


def last_lines(t: Tables) -> DataFrame:
    return t["raw_records"].filter(F.col("uuid").isNotNull()).groupBy(*THREAD, "uuid").agg(
        F.max("line_no").alias("line_no")
    )


def turn_interjections(
    t: Tables, interjections: int = 5, interjection_chars: int = 200
) -> DataFrame:
    """The messages each turn heard, in the order the transcript holds them."""
    heard = (
        t.live("interjections")
        .filter(F.col("turn_id").isNotNull())
        .join(last_lines(t).withColumnRenamed("uuid", "id"), [*THREAD, "id"])
        .withColumn("_order", F.struct("line_no", "id"))
    )
    return _page(heard, TURN, "_order", interjections).select(
        *TURN, "id", "sender", "timestamp", cut(F.col("text"), interjection_chars).alias("text"),
        "line_no", "matched_rows",
    )


def turn_records(t: Tables) -> DataFrame:
    lines = t["raw_records"].select(*THREAD, F.col("uuid").alias("turn_id"), "line_no")
    turns = t.live("turns").select(*THREAD, F.col("id").alias("turn_id"))
    return turns.join(lines, TURN)


_HAPPENED = ["started_at", "source", "index", "tool_call_id"]


def session_errors(t: Tables, errors: int = 20, nav_chars: int = NAV_CHARS) -> DataFrame:
    """The first failures of each session in the order they happened."""
    failed = (
        named_tools(t, nav_chars)
        .filter("is_error")
        .withColumnRenamed("id", "tool_call_id")
        .withColumn("_order", F.struct(*_HAPPENED))
    )
    return _page(failed, ["session_id"], "_order", errors).select(
        *THREAD, "tool_call_id", cut(F.col("name"), nav_chars).alias("name"), "fields",
        "is_error", "started_at", "matched_rows",
    )


def error_steps(t: Tables) -> DataFrame:
    """Each failure with the one before it and the one after it in its session."""
    failed = t.live("tool_calls").filter("is_error").select(
        *THREAD, "index", "started_at", F.col("id").alias("tool_call_id")
    )
    here = F.struct(F.col("source"), F.col("tool_call_id"))
    stepped = running(
        failed, ["session_id"], F.date_trunc("hour", "started_at"), _HAPPENED,
        lasts={"previous": here}, strict=True,
    )
    # The next failure is the one this failure is the previous of.
    following = stepped.filter(F.col("previous").isNotNull()).select(
        "session_id", F.col("previous.source").alias("source"),
        F.col("previous.tool_call_id").alias("tool_call_id"),
        F.struct("source", "tool_call_id").alias("next"),
    )
    return stepped.join(following, [*THREAD, "tool_call_id"], "left").select(
        *THREAD, "tool_call_id", "previous", "next"
    )


def offload_chunk(t: Tables, after_chars: int = 0, chunk_chars: int = 10_000) -> DataFrame:
    return t["offload_files"].select(
        "session_id", "name", "lossy_decode", "size_bytes",
        F.length("content").alias("content_chars"),
        F.substring("content", after_chars + 1, chunk_chars).alias("chunk"),
    )


def node_value(t: Tables, kind: str, field: str) -> DataFrame:
    """One whole value of every node of a kind: the text a page shows the head of."""
    run = ["session_id", "run_id"]
    runs = t.live("agent_runs").withColumnRenamed("id", "run_id")
    tool = F.when(F.col("name") == "Bash", json_field(F.col("input"), "command"))
    plain = F.when(F.col("command_name").isNull(), F.col("prompt"))
    reads: dict[tuple[str, str], tuple[DataFrame, list, Column]] = {}

    def add(k: str, f: str, rows: DataFrame, keys: list, value: Column) -> None:
        reads[k, f] = (rows, keys, value)

    node = [*THREAD, F.col("id")]
    calls, tools, turns = (t.live(n) for n in ("api_calls", "tool_calls", "turns"))
    add("call", "text", calls, node, F.col("text"))
    add("call", "thinking", calls, node, F.col("thinking"))
    add("tool", "input", tools, node, F.col("input"))
    add("tool", "result", tools, node, F.col("result"))
    add("tool", "command", tools, node, tool)
    add("turn", "prompt", turns, node, plain)
    add("turn", "command_args", turns, node, F.col("command_args"))
    add("run", "brief", runs, run, F.col("brief"))
    if kind == "run" and field in ("prompt", "result"):
        add("run", field, _asking(t), run, F.col(field))
    for level, table, keys in (
        ("turn", "turn_enrichments", [*THREAD, F.col("turn_id").alias("id")]),
        ("run", "agent_run_enrichments", ["session_id", F.col("agent_run_id").alias("run_id")]),
        ("session", "session_enrichments", ["session_id"]),
    ):
        for said in ("description", "friction"):
            add(level, said, t[table], keys, F.col(said))
    if (kind, field) not in reads:
        raise KeyError(f"no value {field} on a {kind}")
    rows, keys, value = reads[kind, field]
    return rows.select(*keys, value.alias("value"))
