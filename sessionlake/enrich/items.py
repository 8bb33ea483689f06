"""What gets described, what each description embeds, and the lines its prompt is made of."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.ingest.lines import reject
from sessionlake.operators.relations import Tables, describable_sessions
from sessionlake.operators.sheets import TURN, last_lines, spawn_edges
from sessionlake.operators.tree import ancestors
from sessionlake.operators.windows import THREAD
from sessionlake.schema import MAIN
from sessionlake.session import keep


def item_key(level: str, *parts: Column) -> Column:
    return F.concat_ws(" ", F.lit(level), *parts)


def run_links(t: Tables) -> DataFrame:
    """Each run with the run or main turn that embeds it; neither means its session does. Kept, as
    parents, rounds and sessions' own runs all start from it."""
    return t.once("links", "agent_runs", lambda: keep(_run_links(t), "run_links"))


def _run_links(t: Tables) -> DataFrame:
    runs = t.live("agent_runs").select("session_id", F.col("id").alias("run_id"), "parent_agent_id")
    tools = t.live("tool_calls").select(
        "session_id", F.col("id").alias("tool_use_id"), F.col("source").alias("at"), "api_call_id"
    )
    calls = t.live("api_calls").select(
        "session_id", F.col("source").alias("at"), F.col("id").alias("api_call_id"), "turn_id"
    )
    asked = (
        t.live("agent_runs").select("session_id", F.col("id").alias("run_id"), "tool_use_id")
        .join(tools, ["session_id", "tool_use_id"])
        .filter(F.col("at") != F.col("run_id"))
        .join(calls, ["session_id", "at", "api_call_id"], "left")
        .select("session_id", "run_id", "at", "turn_id")
    )
    parent = F.coalesce("parent_agent_id", F.when(F.col("at") != MAIN, F.col("at")))
    return (
        runs.join(asked, ["session_id", "run_id"], "left")
        .select(
            "session_id", "run_id", parent.alias("parent_run"),
            F.when(parent.isNull(), F.col("turn_id")).alias("parent_turn"),
        )
        .distinct()
    )


def dangling_parents(t: Tables) -> DataFrame:
    """Runs that name a parent run no row holds: no order can be right for a tree with a gap."""
    held = t.live("agent_runs").select("session_id", F.col("id").alias("parent_run"))
    named = run_links(t).filter(F.col("parent_run").isNotNull())
    return reject(
        named.join(held, ["session_id", "parent_run"], "left_anti"), "parent run not held",
        F.concat_ws(" ", "run_id", "parent_run"),
    )


def item_parents(t: Tables) -> DataFrame:
    """(session_id, key, parent): whose prompt carries each item's description."""
    session = F.col("session_id")
    runs = run_links(t).select(
        "session_id", item_key("agent_run", session, F.col("run_id")).alias("key"),
        F.when(
            F.col("parent_run").isNotNull(), item_key("agent_run", session, F.col("parent_run"))
        )
        .when(
            F.col("parent_turn").isNotNull(),
            item_key("turn", session, F.lit(MAIN), F.col("parent_turn")),
        )
        .otherwise(item_key("session", session)).alias("parent"),
    )
    turns = t.live("turns").filter(F.col("source") == MAIN).select(
        "session_id", item_key("turn", session, F.lit(MAIN), F.col("id")).alias("key"),
        item_key("session", session).alias("parent"),
    )
    return runs.unionByName(turns)


def item_ancestors(t: Tables) -> DataFrame:
    return ancestors(item_parents(t), ["session_id"], "key", "parent")


def rounds(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(each run's round, runs in a cycle): leaves first, every run after the runs it embeds.

    A run's height is how much deeper its deepest descendant lies; depth is how many runs lie
    above. A run that lies above itself can never be ready.
    """
    edges = run_links(t).filter(F.col("parent_run").isNotNull()).select(
        "session_id", "run_id", F.col("parent_run").alias("above")
    )
    up = ancestors(edges, ["session_id"], "run_id", "above")
    looped = up.filter(F.col("run_id") == F.col("above")).select("session_id", "run_id")
    runs = t.live("agent_runs").select("session_id", F.col("id").alias("run_id"))
    depth = up.groupBy("session_id", "run_id").agg(F.count(F.lit(1)).alias("depth"))
    placed = runs.join(looped, ["session_id", "run_id"], "left_anti").join(
        depth, ["session_id", "run_id"], "left"
    ).withColumn("depth", F.coalesce("depth", F.lit(0)))
    deepest = (
        up.join(placed, ["session_id", "run_id"])
        .groupBy("session_id", F.col("above").alias("run_id"))
        .agg(F.max("depth").alias("deepest"))
    )
    heights = placed.join(deepest, ["session_id", "run_id"], "left").select(
        "session_id", "run_id",
        F.coalesce(F.col("deepest") - F.col("depth"), F.lit(0)).cast("int").alias("round"),
    )
    return heights, reject(looped, "run parentage has a cycle", F.col("run_id"))


# Fixed value: the tag a command's printed output is archived in.
STDOUT_TAG = "local-command-stdout"


def command_results(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(what each main command turn printed, lines that cannot be read), in transcript order."""
    body = f"(?s)<{STDOUT_TAG}>(.*?)</{STDOUT_TAG}>"
    turns = t.live("turns").filter(
        (F.col("source") == MAIN) & F.col("command_name").isNotNull()
    ).select(*THREAD, F.col("id").alias("turn_id"))
    carriers = (
        t["raw_records"]
        .filter((F.col("source") == MAIN) & F.contains("raw", F.lit(f"<{STDOUT_TAG}>")))
        .select(
            *THREAD, "line_no", F.get_json_object("raw", "$.parentUuid").alias("turn_id"),
            F.coalesce(
                F.get_json_object("raw", "$.message.content"),
                F.get_json_object("raw", "$.content"),
            ).alias("carrier"),
        )
        .join(turns, TURN)
    )
    readable = F.coalesce(F.col("carrier").rlike(body), F.lit(False))
    bad = reject(
        carriers.filter(~readable), "unreadable command result",
        F.concat_ws(" ", "source", "line_no"),
    )
    printed = carriers.filter(readable).groupBy(*TURN).agg(
        F.array_join(
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.struct("line_no", F.regexp_extract("carrier", body, 1).alias("body"))
                    )
                ),
                lambda r: r["body"],
            ),
            "\n",
        ).alias("command_result")
    )
    return printed, bad


@dataclass(frozen=True)
class Budgets:
    """Characters each part of a prompt may take."""

    total: int = 30_000
    prompt: int = 4_000
    text: int = 1_500
    input_head: int = 120
    error_tail: int = 300
    command_result: int = 2_000
    task_notice: int = 400


SESSION_TOTAL = 24_000


def _dropped(count: Column) -> Column:
    return F.concat(F.lit("[+"), count.cast("string"), F.lit(" chars]"))


def cap(text: Column, limit: int) -> Column:
    """The head of a text and how much was left behind, within the limit."""
    size = F.length(text)
    kept = F.lit(limit) - F.length(_dropped(size))
    return (
        F.when(size <= limit, text)
        .when(kept > 0, F.concat(F.substr(text, F.lit(1), kept), _dropped(size - kept)))
        .otherwise(F.substring(text, 1, limit))
    )


def tail(text: Column, limit: int) -> Column:
    """The end of a text, where an error says what failed, within the limit."""
    size = F.length(text)
    kept = F.lit(limit) - F.length(_dropped(size))
    return (
        F.when(size <= limit, text)
        .when(kept > 0, F.concat(_dropped(size - kept), F.right(text, kept)))
        .otherwise(F.right(text, F.lit(limit)))
    )


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def duration(ms: Column) -> Column:
    """A span of time in the two largest units that carry it."""
    seconds, minutes = F.floor(ms / 1000), F.floor(ms / 60_000)

    def two(a: Column, x: str, b: Column, y: str) -> Column:
        return F.concat(a.cast("string"), F.lit(x + " "), b.cast("string"), F.lit(y))

    return (
        F.when(ms.isNull(), "unknown")
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(minutes < 60, two(minutes, "m", seconds % 60, "s"))
        .when(minutes < 1440, two(F.floor(minutes / 60), "h", minutes % 60, "m"))
        .otherwise(two(F.floor(minutes / 1440), "d", F.floor(minutes % 1440 / 60), "h"))
    )


# What a message heard mid-turn is headed by, and the notice tag.
HEARD = {
    "person": "## Mid-turn message from the person",
    "agent": "## Mid-turn message from another agent",
    "task": "## Mid-turn notice from a background task",
}
NOTICE = "<task-notification>"
CONTINUATION = "This run continues a conversation another transcript holds; its task is not here."


def _each_notice(text: Column, limit: int) -> Column:
    """Every notice of a batch capped on its own, the space between them kept."""
    parts = F.split(text, NOTICE, -1)
    head = cap(F.element_at(parts, 1), limit)

    def one(part: Column) -> Column:
        whole = F.concat(F.lit(NOTICE), part)
        kept = F.regexp_replace(whole, r"\s+$", "")
        return F.concat(cap(kept, limit), F.substr(whole, F.length(kept) + 1))

    return F.concat(head, F.array_join(F.transform(F.slice(parts, 2, 2**30), one), ""))


def _line_rows(rows: DataFrame, keys: list[str], at: list[Column], texts: Column) -> DataFrame:
    """Lines of a prompt: `at` says where they go, `texts` is what one row contributes in order."""
    order = F.struct(*[c.cast("long").alias(f"o{i}") for i, c in enumerate(at)])
    return rows.select(*keys, order.alias("at"), F.posexplode(F.array_compact(texts)).alias("i", "line"))


def spawned_descriptions(t: Tables) -> DataFrame:
    """A spawned run's description beside the call that asked for it, never the run's own copy. Kept, as
    the prompts of turns and of runs both name them."""
    return t.once("spawned", "descriptions", lambda: keep(_spawned_descriptions(t), "spawned"))


def _spawned_descriptions(t: Tables) -> DataFrame:
    said = t["agent_run_enrichments"].select(
        "session_id", F.col("agent_run_id").alias("run_id"), "description"
    )
    return (
        spawn_edges(t).filter(F.col("spawn_source").isNotNull())
        .join(said, ["session_id", "run_id"])
        .groupBy("session_id", F.col("spawn_source").alias("source"),
                 F.col("tool_use_id").alias("id"))
        .agg(F.max("description").alias("spawned"))
    )


def _thread_lines(
    t: Tables, threads: Column, section: DataFrame, calls: DataFrame, keys: list[str], b: Budgets
) -> DataFrame:
    """The heard messages, responses and tool lines of each section of a thread.

    `section` maps a thread's turns (NULL for none) to the item they belong to and its place in it,
    `calls` are those of `section_calls`; no section is of a thread that fails `threads`.
    """
    zero = F.lit(0)
    asides = t.live("interjections").filter(threads & F.col("turn_id").isNotNull())
    heard = (
        asides.join(last_lines(t).filter(threads).withColumnRenamed("uuid", "id"), [*THREAD, "id"])
        .join(section, TURN)
    )
    header = F.create_map(*[F.lit(x) for pair in HEARD.items() for x in pair])
    words = F.when(
        F.col("sender") == "task", _each_notice(F.col("text"), b.task_notice)
    ).otherwise(cap(F.col("text"), b.prompt))
    heard_lines = _line_rows(
        heard, keys, [F.col("place"), F.lit(1), F.col("line_no"), zero],
        F.array(F.lit(""), F.try_element_at(header, F.col("sender")), words),
    )
    # A column at each step, so that a text is stripped and capped once.
    spoken = calls.withColumn("_bare", strip(F.col("text"))).withColumn("_said", cap(F.col("_bare"), b.text))
    text = F.col("_said")
    responses = _line_rows(
        spoken, keys, [F.col("place"), F.lit(2), F.col("index"), F.lit(-1)],
        F.array(F.lit(""), F.lit("## Response"), F.when(text != "", text)),
    )
    said = F.when(F.col("incomplete"), "unanswered").when(F.col("result").isNull(), "no result").otherwise(
        F.concat(F.lit("result "), F.length("result").cast("string"), F.lit(" chars"),
                 F.when(F.col("is_error"), ", ERROR").otherwise(""))
    )
    line = F.concat(
        F.lit("- "), "name", F.lit(" (input "), F.length("input").cast("string"),
        F.lit(" chars, "), said, F.lit(") "), one_line(cap(F.col("input"), b.input_head)),
        F.when(
            F.col("is_error") & (F.length("result") > 0),
            F.concat(F.lit(" | error tail: "), one_line(tail(F.col("result"), b.error_tail))),
        ).otherwise(""),
        F.when(
            F.col("spawned").isNotNull(), F.concat(F.lit(" | subagent: "), one_line(F.col("spawned")))
        ).otherwise(""),
    )
    placed = calls.select(
        *dict.fromkeys([*THREAD, *keys]), "place", F.col("id").alias("api_call_id"), F.col("index").alias("call_index")
    )
    tools = (
        t.live("tool_calls").filter(threads)
        .join(placed, [*THREAD, "api_call_id"])
        .join(spawned_descriptions(t).filter(threads), [*THREAD, "id"], "left")
    )
    tool_lines = _line_rows(
        tools, keys, [F.col("place"), F.lit(2), F.col("call_index"), F.col("index")], F.array(line)
    )
    last = calls.groupBy(*keys).agg(
        F.max_by(F.coalesce("stop_reason", F.lit("not recorded")), F.struct("place", "index"))
        .alias("reason")
    )
    items = section.select(*keys).distinct()
    ended = _line_rows(
        items.join(last, keys, "left"), keys, [F.lit(2**40), zero, zero, zero],
        F.array(
            F.lit(""),
            F.concat(F.lit("## Ended: "), F.coalesce("reason", F.lit("no model response"))),
        ),
    )
    return reduce(DataFrame.unionByName, [heard_lines, responses, tool_lines, ended])


def section_calls(t: Tables, threads: Column, section: DataFrame) -> DataFrame:
    """Calls with the section of their turn; one whose turn no section holds has none, and is in the
    section of its thread's calls without a turn. Kept, as lines and heads read it."""
    turns = section.filter(F.col("turn_id").isNotNull())
    known = turns.select(*TURN, F.lit(True).alias("_held"))
    calls = (
        t.live("api_calls").filter(threads).select(*TURN, "id", "index", "text", "stop_reason")
        .join(known, TURN, "left")
    )
    held = calls.filter("_held").drop("_held").join(turns, TURN)
    loose = calls.filter(F.col("_held").isNull()).drop("_held", "turn_id").join(
        section.filter(F.col("turn_id").isNull()), THREAD
    )
    return keep(held.unionByName(loose), "section_calls")


@dataclass(frozen=True)
class Draft:
    """Prompts before they are fitted: a head per item, and the lines that follow it."""

    keys: list[str]
    heads: DataFrame
    lines: DataFrame


def turn_draft(t: Tables, b: Budgets = Budgets()) -> Draft:
    """Main turns: what was asked, then everything the turn heard, said and ran."""
    turns = t.live("turns").filter(F.col("source") == MAIN).withColumnRenamed("id", "turn_id")
    printed, _ = command_results(t)
    result = F.col("command_result")
    block = (
        F.when(result.isNull(), "## Command result: not recorded")
        .when(result == "", "## Command result: the command printed nothing")
        .otherwise(F.concat(F.lit("## Command result\n"), cap(result, b.command_result)))
    )
    named = F.concat_ws(
        " ", F.nullif("command_name", F.lit("")), F.nullif("command_args", F.lit(""))
    )
    head = F.when(
        F.col("command_name").isNotNull(),
        F.concat(F.lit("# Main turn\n\n## Command\n"), named, F.lit("\n\n"), block),
    ).otherwise(F.concat(F.lit("# Main turn\n\n## Prompt\n"), cap(F.col("prompt"), b.prompt)))
    heads = turns.join(printed, TURN, "left").select(*TURN, head.alias("head"))
    section = turns.select(*TURN, F.lit(0).alias("place"))
    main = F.col("source") == MAIN
    calls = section_calls(t, main, section)
    return Draft(TURN, heads, _thread_lines(t, main, section, calls, TURN, b))


def run_draft(t: Tables, b: Budgets = Budgets()) -> Draft:
    """Agent runs: every instruction and the work each drove; a fork's inherited work comes first."""
    keys = ["session_id", "run_id"]
    runs = t.live("agent_runs").select(
        "session_id", F.col("id").alias("run_id"), F.col("id").alias("source"), "agent_type"
    )
    turns = t.live("turns").filter(F.col("source") != MAIN).select(
        *THREAD, F.col("id").alias("turn_id"), "index", "prompt"
    ).join(runs, THREAD)
    local = turns.select(*keys, "source", "turn_id", (F.col("index") + 1).alias("place"))
    none = F.lit(None).cast("string")
    loose = runs.select(*keys, "source", none.alias("turn_id"), F.lit(0).alias("place"))
    section = local.unionByName(loose)
    # The main thread has no section here, unless a run goes by its name.
    aliased = runs.filter(F.col("run_id") == MAIN).limit(1).count()
    threads = F.lit(True) if aliased else F.col("source") != MAIN
    calls = section_calls(t, threads, section)
    turnless = (
        calls.filter(F.col("turn_id").isNull()).select(*THREAD).distinct()
        .withColumn("_loose", F.lit(True))
    )
    wrapped = r"(?is)^<teammate-message\b[^>]*>(.*)</teammate-message>$"
    bare = F.when(
        strip(F.col("prompt")).rlike(wrapped),
        strip(F.regexp_extract(strip(F.col("prompt")), wrapped, 1)),
    ).otherwise(F.col("prompt"))
    opening = cap(bare, b.prompt)
    first = turns.groupBy(*keys).agg(
        F.min("index").alias("index"), F.min_by(opening, "index").alias("task")
    )
    titled = F.concat(F.lit("# Agent run: "), "agent_type")
    opened = F.when(
        F.col("_loose"), F.concat(F.lit("\n\n## Continuation\n"), F.lit(CONTINUATION))
    ).otherwise(F.concat(F.lit("\n\n## Task\n"), "task"))
    heads = (
        runs.join(turnless, THREAD, "left").join(first, keys, "left")
        .select(*keys, F.concat(titled, F.coalesce(opened, F.lit(""))).alias("head"))
    )
    # The first instruction is the head's, unless a continuation took its place there.
    later = turns.join(turnless, THREAD, "left").join(
        first.select(*keys, F.col("index").alias("_first")), keys
    )
    is_first = F.col("index") == F.col("_first")
    instructions = _line_rows(
        later.filter(~is_first | F.coalesce("_loose", F.lit(False))), keys,
        [F.col("index") + 1, F.lit(0), F.lit(0), F.lit(0)],
        F.array(
            F.lit(""), F.when(is_first, "## Task").otherwise("## Instruction"), opening
        ),
    )
    return Draft(keys, heads, instructions.unionByName(_thread_lines(t, threads, section, calls, keys, b)))


def _thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def session_draft(t: Tables) -> Draft:
    """Sessions: what they cost, and a line for each thing they did, in the order it started."""
    keys = ["session_id"]
    r = t.rollups("live").join(describable_sessions(t), "session_id", "left_semi").join(
        t["sessions"].select(F.col("id").alias("session_id"), "git_branch"), "session_id"
    )
    head = F.concat(
        F.lit("# Session: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("untitled")),
        F.lit("\n\n## Metrics\nbranch "),
        F.coalesce(F.nullif("git_branch", F.lit("")), F.lit("unknown")),
        F.lit("\nwall "), duration(F.col("wall_ms")), F.lit(", active "),
        duration(F.col("active_ms")), F.lit("\ntokens "), _thousands(F.col("input_tokens")),
        F.lit(" in, "), _thousands(F.col("output_tokens")), F.lit(" out, "),
        _thousands(F.col("cache_read_tokens")), F.lit(" cache read, "),
        _thousands(F.col("cache_creation_tokens")), F.lit(" cache write\ncost $"),
        F.format_string("%.2f", F.bround("cost_usd", 2)), F.lit("\n\n## Work"),
    )
    said = ("description", "category", "outcome")
    turns = t.live("turns").filter(F.col("source") == MAIN).select(
        *THREAD, F.col("id").alias("turn_id"), "index", "started_at"
    ).join(t["turn_enrichments"].select(*TURN, *said), TURN, "left").select(
        "session_id", "started_at", F.lit(0).alias("run"), F.col("index").alias("nth"),
        F.lit("Main turn").alias("label"), F.col("turn_id").alias("id"), *said,
    )
    loose = run_links(t).filter(
        F.col("parent_run").isNull() & F.col("parent_turn").isNull()
    ).select("session_id", F.col("run_id").alias("id"))
    runs = (
        t.live("agent_runs").select("session_id", "id", "agent_type", "started_at")
        .join(loose, ["session_id", "id"])
        .join(
            t["agent_run_enrichments"].select("session_id", F.col("agent_run_id").alias("id"), *said),
            ["session_id", "id"], "left",
        )
        .select(
            "session_id", "started_at", F.lit(1).alias("run"), F.lit(0).alias("nth"),
            F.concat(F.lit("Agent run ("), "agent_type", F.lit(")")).alias("label"), "id", *said,
        )
    )
    line = F.when(
        F.col("description").isNull(), F.concat(F.lit("- "), "label", F.lit(" [not described yet]"))
    ).otherwise(
        F.concat(F.lit("- "), "label", F.lit(" ["), "category", F.lit("/"), "outcome", F.lit("] "),
                 one_line(F.col("description")))
    )
    late = F.lit(2**62)
    children = turns.unionByName(runs).join(describable_sessions(t), "session_id", "left_semi")
    lines = _line_rows(
        children, keys,
        [F.coalesce(F.unix_micros("started_at"), late), F.col("run"), F.col("nth"),
         F.xxhash64("id")],
        F.array(line),
    )
    return Draft(keys, r.select("session_id", head.alias("head")), lines)
