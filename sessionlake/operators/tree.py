"""The session as a tree: where every node hangs, in what order, what it cost with what is under it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlake.functions.tools import tool_words
from sessionlake.operators.context import compactions
from sessionlake.operators.corpus import money
from sessionlake.operators.relations import Tables
from sessionlake.operators.sheets import (
    CALL,
    named_tools,
    own_turn,
    repeated_tools,
    spawn_edges,
    tools_tally,
)
from sessionlake.operators.windows import THREAD, block_of, running
from sessionlake.schema import MAIN
from sessionlake.session import keep

NO_SOURCE = "-"


def key_of(kind: str | Column, source: Column, node: Column) -> Column:
    """A node's name within its session: kind, thread, id."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(" ", kind, source, node)


def session_key(session: Column) -> Column:
    return key_of("session", F.lit(NO_SOURCE), session)


def unattached_key(session: Column) -> Column:
    return key_of("unattached", F.lit(NO_SOURCE), session)


def thread_key(source: Column, session: Column) -> Column:
    """What a thread hangs off: the session for the main one, else the run it belongs to."""
    return F.when(source == MAIN, session_key(session)).otherwise(key_of("run", source, source))


def home_key(source: Column, turn: Column) -> Column:
    """Where a call sits: the turn it answers, else its thread's bucket."""
    return F.when(turn.isNull(), key_of("unattributed", source, source)).otherwise(
        key_of("turn", source, turn)
    )


def run_parents(t: Tables) -> DataFrame:
    """(session_id, run_id, above): the run each run hangs under, if any.

    The parent the transcript names where the session holds it, else the thread that asked.
    """
    runs = t.live("agent_runs").select("session_id", F.col("id").alias("run_id"), "parent_agent_id")
    held = runs.select("session_id", F.col("run_id").alias("parent_agent_id"), F.lit(True).alias("_p"))
    asked = spawn_edges(t).select("session_id", "run_id", "spawn_source")
    above = F.when(F.col("_p"), F.col("parent_agent_id")).otherwise(F.col("spawn_source"))
    named = (
        runs.join(held, ["session_id", "parent_agent_id"], "left")
        .join(asked, ["session_id", "run_id"], "left")
        .select("session_id", "run_id", above.alias("above"))
    )
    known = runs.select("session_id", F.col("run_id").alias("above"))
    return named.join(known, ["session_id", "above"], "left_semi").select(
        "session_id", "run_id", "above"
    )


def ancestors(edges: DataFrame, keys: list[str], node: str, above: str) -> DataFrame:
    """Every node with every node above it, a cycle's own members included.

    Paths double in length each round, so a tree sixteen deep takes four; the pairs are kept
    as a table every round and the rounds end when one adds nothing. Links to a top, which has nothing
    above it, end every path they are on: they are set beside the others' paths once, after the rounds.
    """
    links = keep(edges.select(*keys, node, above).distinct(), "links")
    held = links.select(*keys, F.col(node).alias(above)).distinct().hint("merge")
    tops = links.join(held, [*keys, above], "left_anti")
    reach = keep(links.join(held, [*keys, above], "left_semi").select(*keys, node, above), "reach")
    count = reach.count()
    while count:
        further = reach.select(*keys, F.col(node).alias(above), F.col(above).alias("_top"))
        longer = reach.join(further.hint("merge"), [*keys, above]).select(
            *keys, node, F.col("_top").alias(above)
        )
        reach = keep(reach.unionByName(longer).distinct(), "reach")
        grown = reach.count()
        if grown == count:
            break
        count = grown
    ends = tops.select(*keys, F.col(node).alias(above), F.col(above).alias("_top")).hint("merge")
    ended = reach.join(ends, [*keys, above]).select(*keys, node, F.col("_top").alias(above))
    topped = tops.select(*keys, node, above).unionByName(ended).distinct()
    return keep(reach.unionByName(topped), "reach")


def run_ancestors(t: Tables) -> DataFrame:
    return ancestors(run_parents(t), ["session_id"], "run_id", "above")


def run_costs(t: Tables) -> DataFrame:
    spent = (
        t.live("api_calls").groupBy("session_id", F.col("source").alias("run_id"))
        .agg(
            money(F.sum("cost_usd")).alias("cost_usd"),
            F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
        )
    )
    runs = t.live("agent_runs").select("session_id", F.col("id").alias("run_id"))
    return runs.join(spent, ["session_id", "run_id"], "left").select(
        "session_id", "run_id", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("unpriced_api_calls", F.lit(0)).alias("unpriced_api_calls"),
    )


def asking_nodes(t: Tables) -> DataFrame:
    """(session_id, key, run_id): the tool call, call and turn or bucket that asked for a run."""
    e = spawn_edges(t).filter(F.col("spawn_source").isNotNull())
    source = F.col("spawn_source")
    asked = F.array(
        key_of("tool", source, F.col("tool_use_id")),
        key_of("call", source, F.col("spawn_call_id")),
        home_key(source, F.col("spawn_turn_id")),
    )
    return e.select("session_id", F.explode(asked).alias("key"), "run_id")


def ledger_entries(t: Tables) -> DataFrame:
    """(session_id, key, run_id): every node each run is charged to, once."""
    up = run_ancestors(t)
    asked = asking_nodes(t)
    climbed = up.select("session_id", F.col("run_id").alias("charged"), F.col("above").alias("run_id"))
    through = climbed.join(asked, ["session_id", "run_id"]).select(
        "session_id", "key", F.col("charged").alias("run_id")
    )
    over = up.select("session_id", key_of("run", F.col("above"), F.col("above")).alias("key"), "run_id")
    whole = t.live("agent_runs").select(
        "session_id", session_key(F.col("session_id")).alias("key"), F.col("id").alias("run_id")
    )
    return asked.unionByName(through).unionByName(over).unionByName(whole).distinct()


def ledger(t: Tables) -> DataFrame:
    """What hangs under each node: the runs, and what their own threads spent."""
    return (
        ledger_entries(t)
        .join(run_costs(t), ["session_id", "run_id"])
        .groupBy("session_id", "key")
        .agg(money(F.sum("cost_usd")).alias("under_usd"), F.count(F.lit(1)).alias("runs"))
    )


def hidden_runs(t: Tables) -> DataFrame:
    """The runs a closed row stands for: those its own rows would have led to."""
    e = spawn_edges(t)
    source = F.col("spawn_source")
    by_thread = e.filter(source.isNotNull() & (source != MAIN)).select(
        "session_id", key_of("run", source, source).alias("key"), "run_id"
    )
    loose = e.filter(source.isNull()).select(
        "session_id", unattached_key(F.col("session_id")).alias("key"), "run_id"
    )
    return asking_nodes(t).unionByName(by_thread).unionByName(loose)


_ORD = "struct<grp:int,at:timestamp,mark:int,nth:bigint,id:string>"


def _ord(grp: int, at: Column, mark: int, nth: Column, node: Column) -> Column:
    return F.struct(
        F.lit(grp).alias("grp"), at.cast("timestamp").alias("at"), F.lit(mark).alias("mark"),
        nth.cast("long").alias("nth"), node.cast("string").alias("id"),
    ).cast(_ORD)


def _latest_start(rows: DataFrame, parent: list[str], order: list[str], block: Column) -> DataFrame:
    """The latest start among a row and its siblings before it.

    A compaction stands before the first sibling that started after it, and along a level the
    latest start only grows: so siblings in their own order and compactions by their time
    merge into one sort.
    """
    return running(rows, parent, block, order, maxes={"latest": F.col("started_at")})


_NODE = ["session_id", "key", "kind", "source", "id", "parent", "ord"]


def nodes(t: Tables) -> DataFrame:
    """Every node of every session with its parent and its place among its siblings."""
    session, source = F.col("session_id"), F.col("source")
    none, zero = F.lit(None), F.lit(0)

    def node(rows: DataFrame, kind: str, at: Column, ident: Column, parent: Column, ord_: Column):
        return rows.select(
            "session_id", key_of(kind, at, ident).alias("key"), F.lit(kind).alias("kind"),
            at.alias("source"), ident.alias("id"), parent.alias("parent"), ord_.alias("ord"),
        )

    roots = node(
        t["sessions"].select(F.col("id").alias("session_id")), "session", F.lit(NO_SOURCE),
        session, none.cast("string"), _ord(0, none, 0, zero, session),
    )
    turns = _latest_start(
        t.live("turns").select(*THREAD, "id", "index", "started_at"), THREAD, ["index"],
        block_of(F.col("index")),
    )
    placed_turns = node(
        turns, "turn", source, F.col("id"), thread_key(source, session),
        _ord(0, F.col("latest"), 0, F.col("index"), F.col("id")),
    )
    calls = own_turn(t, t.live("api_calls")).select(
        *THREAD, "turn_id", "id", "index", "started_at"
    )
    homed = calls.withColumn("parent", home_key(source, F.col("turn_id")))
    timed = _latest_start(homed, ["session_id", "parent"], ["index"], block_of(F.col("index")))
    placed_calls = node(
        timed, "call", source, F.col("id"), F.col("parent"),
        _ord(0, F.col("latest"), 0, F.col("index"), F.col("id")),
    )
    buckets = node(
        calls.filter(F.col("turn_id").isNull()).select(*THREAD).distinct(), "unattributed",
        source, source, thread_key(source, session), _ord(1, none, 0, zero, source),
    )
    tools = t.live("tool_calls").join(
        calls.select(*THREAD, F.col("id").alias("api_call_id")), CALL, "left_semi"
    )
    placed_tools = node(
        tools, "tool", source, F.col("id"), key_of("call", source, F.col("api_call_id")),
        _ord(0, none, 0, F.col("index"), F.col("id")),
    )
    marks = compactions(t)
    in_turn = F.col("turn_id").isNotNull()
    placed_marks = node(
        marks, "compaction", source, F.col("compaction_id"),
        F.when(in_turn, key_of("turn", source, F.col("turn_id"))).otherwise(
            thread_key(source, session)
        ),
        _ord(0, F.col("timestamp"), 1, zero, F.col("compaction_id")),
    )
    edges = spawn_edges(t)
    started = t.live("agent_runs").select("session_id", F.col("id").alias("run_id"), "started_at")
    runs = edges.join(started, ["session_id", "run_id"])
    asked = F.col("spawn_source")
    run = F.col("run_id")
    # A run without a start comes after its siblings that have one.
    placed_runs = node(
        runs, "run", run, run,
        F.when(asked.isNull(), unattached_key(session)).otherwise(
            key_of("tool", asked, F.col("tool_use_id"))
        ),
        _ord(0, F.coalesce(F.col("started_at"), F.timestamp_micros(F.lit(2**62))), 0, zero, run),
    )
    loose = node(
        edges.filter(asked.isNull()).select("session_id").distinct(), "unattached",
        F.lit(NO_SOURCE), session, session_key(session), _ord(2, none, 0, zero, session),
    )
    parts = [
        roots, placed_turns, placed_calls, buckets, placed_tools, placed_marks, placed_runs, loose,
    ]
    return reduce(DataFrame.unionByName, parts)


def numbered(level: DataFrame) -> DataFrame:
    """Children numbered from 0 under their parent, through the fold that spreads a wide parent."""
    hour = F.coalesce(F.date_trunc("hour", "ord.at"), F.timestamp_micros(F.lit(0)))
    return running(
        level, ["session_id", "parent"],
        F.struct(
            "ord.grp", hour,
            F.when(F.col("ord.at").isNull(), block_of(F.col("ord.nth"))).otherwise(F.lit(0)),
        ),
        ["ord"], counts={"place": F.lit(True)},
    )


def children(t: Tables, preset: str = "full") -> DataFrame:
    """(session_id, parent, key, kind, ord) of one reading of the tree.

    `full` is the tree itself. `no_api` folds the calls away and stands their tools under the turn,
    among its compactions. `agents` keeps runs alone: the main thread's under the session, the
    others under the run the transcript names.
    """
    whole = nodes(t)
    if preset == "full":
        return whole.filter(F.col("parent").isNotNull()).select(*_NODE)
    if preset == "no_api":
        calls = own_turn(t, t.live("api_calls")).select(
            *THREAD, F.col("id").alias("api_call_id"), F.col("index").alias("call_index"),
            home_key(F.col("source"), F.col("turn_id")).alias("parent"),
        )
        tools = t.live("tool_calls").select(
            *CALL, "id", "index", "started_at"
        ).join(calls, CALL).withColumn(
            "nth", F.col("call_index").cast("long") * F.lit(2**32) + F.col("index")
        )
        timed = _latest_start(
            tools, ["session_id", "parent"], ["nth"], block_of(F.col("call_index"))
        )
        hoisted = timed.select(
            "session_id", key_of("tool", F.col("source"), F.col("id")).alias("key"),
            F.lit("tool").alias("kind"), "source", "id", "parent",
            _ord(0, F.col("latest"), 0, F.col("nth"), F.col("id")).alias("ord"),
        )
        kept = whole.filter(F.col("parent").isNotNull() & ~F.col("kind").isin("call", "tool"))
        return kept.select(*_NODE).unionByName(hoisted)
    if preset != "agents":
        raise KeyError(f"no such preset: {preset}")
    runs = whole.filter(F.col("kind") == "run").drop("parent")
    edges = spawn_edges(t).select(
        "session_id", F.col("run_id").alias("id"), "spawn_source"
    ).join(
        t.live("agent_runs").select("session_id", "id", "parent_agent_id"), ["session_id", "id"]
    )
    session, named = F.col("session_id"), F.col("parent_agent_id")
    hangs = edges.select(
        "session_id", "id",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("spawn_source") == MAIN, session_key(session)),
                    F.when(F.col("spawn_source").isNull(), unattached_key(session)),
                    F.when(named.isNotNull(), key_of("run", named, named)),
                ),
                lambda k: k.isNotNull(),
            )
        ).alias("parent"),
    )
    bucket = whole.filter(F.col("kind") == "unattached")
    return runs.join(hangs, ["session_id", "id"]).select(*_NODE).unionByName(bucket.select(*_NODE))


def walk(t: Tables) -> DataFrame:
    """Each node with the one read before it and the one read after it.

    Before: the sibling ahead, else the parent. After: the following sibling, else whatever follows
    the parent, and so on up to the session; the climb doubles its reach each round. Both sides of its joins
    have rows as the tree has nodes, and names pack well on disk: none is broadcast through the driver.
    """
    level = numbered(nodes(t).filter(F.col("parent").isNotNull())).select(
        "session_id", "key", "parent", "place"
    )
    level = keep(level, "level")
    ahead = level.select(
        "session_id", "parent", (F.col("place") - 1).alias("place"), F.col("key").alias("after")
    )
    behind = level.select(
        "session_id", "parent", (F.col("place") + 1).alias("place"), F.col("key").alias("before")
    )
    sided = (
        level.join(ahead.hint("merge"), ["session_id", "parent", "place"], "left")
        .join(behind.hint("merge"), ["session_id", "parent", "place"], "left")
        .select("session_id", "key", "parent", "before", "after")
    )
    # The nodes that end their level pass on to their parent; one per parent, however wide it is.
    ends = keep(
        sided.filter(F.col("after").isNull()).select("session_id", "key", F.col("parent").alias("at")), "ends"
    )
    # A node that no end of a level stands for has reached its place; the others climb on, twice as
    # far each round. No climb is longer than there are ends, so only rings are left turning then.
    for _ in range(ends.count().bit_length()):
        hop = ends.select("session_id", F.col("key").alias("at"), F.col("at").alias("_next"))
        climbed = keep(
            ends.join(hop.hint("merge"), ["session_id", "at"], "left").select(
                "session_id", "key", F.coalesce("_next", "at").alias("at"),
                F.col("_next").isNotNull().alias("_moved"),
            ),
            "climbed",
        )
        ends = climbed.drop("_moved")
        if not climbed.filter("_moved").limit(1).count():
            break
    follows = sided.filter(F.col("after").isNotNull()).select(
        "session_id", F.col("key").alias("at"), F.col("after").alias("climbed_to")
    )
    climbs = ends.join(follows.hint("merge"), ["session_id", "at"], "left").select(
        "session_id", "key", "climbed_to"
    )
    return sided.join(climbs.hint("merge"), ["session_id", "key"], "left").select(
        "session_id", "key", F.coalesce("before", "parent").alias("previous"),
        F.coalesce("after", "climbed_to").alias("next"),
    )


# What the two buckets are called.
UNATTRIBUTED_TITLE = "calls under no turn of this thread"
UNATTACHED_TITLE = "runs attached to no turn"


def titles(t: Tables, chars: int = 100) -> DataFrame:
    """(session_id, key, title): what each node is called."""
    said = t["session_enrichments"].select("session_id", "description")
    session = F.col("session_id")
    sessions = (
        t["sessions"].select(F.col("id").alias("session_id"), "title")
        .join(said, "session_id", "left")
        .select(
            "session_id", session_key(session).alias("key"),
            F.coalesce("description", "title", "session_id").alias("title"),
        )
    )
    source, ident = F.col("source"), F.col("id")
    command = F.trim(
        F.concat(F.col("command_name"), F.lit(" "), F.coalesce("command_args", F.lit("")))
    )
    described = t["turn_enrichments"].select(*THREAD, F.col("turn_id").alias("id"), "description")
    turns = (
        t.live("turns").join(described, [*THREAD, "id"], "left")
        .select(
            "session_id", key_of("turn", source, ident).alias("key"),
            F.coalesce("description", command, "prompt").alias("title"),
        )
    )
    run_said = t["agent_run_enrichments"].select(
        "session_id", F.col("agent_run_id").alias("id"), "description"
    )
    runs = (
        t.live("agent_runs").join(run_said, ["session_id", "id"], "left")
        .select(
            "session_id", key_of("run", ident, ident).alias("key"),
            F.trim(
                F.concat(
                    F.lit("["), "agent_type", F.lit("] "),
                    F.coalesce("description", "brief", F.lit("")),
                )
            ).alias("title"),
        )
    )
    # Inputs are read once: what a call and what a tool is called both come from a tool's words.
    named = keep(
        named_tools(t, chars, repeated_tools(t)).select(
            *CALL, "id", "index", "name", "nth",
            tool_words(F.col("name"), F.col("fields")).alias("words"),
        ),
        "tool_words",
    )
    tally = tools_tally(named, ["words"])
    first = F.col("first")
    rest = F.array_join(
        F.transform(
            F.col("rest"),
            lambda k: F.concat(F.lit(" +"), k["n"], F.lit("("), k["name"], F.lit(")")),
        ),
        "",
    )
    calls = (
        t.live("api_calls").withColumnRenamed("id", "api_call_id").join(tally, CALL, "left")
        .select(
            "session_id", key_of("call", source, F.col("api_call_id")).alias("key"),
            F.when(F.col("text") != "", F.col("text"))
            .when(
                first.isNotNull(),
                F.concat(first["words"], rest),
            )
            .otherwise(F.col("model")).alias("title"),
        )
    )
    tools = named.select(
        "session_id", key_of("tool", source, ident).alias("key"), F.col("words").alias("title")
    )
    marks = t.live("compactions").select(
        "session_id", key_of("compaction", source, ident).alias("key"),
        F.concat(F.lit("compaction · "), "trigger").alias("title"),
    )
    buckets = nodes_of_buckets(t)
    return reduce(DataFrame.unionByName, [sessions, turns, runs, calls, tools, marks, buckets])


def nodes_of_buckets(t: Tables) -> DataFrame:
    source = F.col("source")
    turnless = (
        own_turn(t, t.live("api_calls")).filter(F.col("turn_id").isNull()).select(*THREAD).distinct()
        .select(
            "session_id", key_of("unattributed", source, source).alias("key"),
            F.lit(UNATTRIBUTED_TITLE).alias("title"),
        )
    )
    loose = (
        spawn_edges(t).filter(F.col("spawn_source").isNull()).select("session_id").distinct()
        .select(
            "session_id", unattached_key(F.col("session_id")).alias("key"),
            F.lit(UNATTACHED_TITLE).alias("title"),
        )
    )
    return turnless.unionByName(loose)


def node_spend(t: Tables) -> DataFrame:
    """Each node's own cost, its total with the runs under it, and both as shares of its session.

    A session's cost is the whole of its tree, so its own is what the runs leave of it. A tool call
    costs nothing unless it asked for a run; then it is charged what the call holding it cost.
    """
    session, source = F.col("session_id"), F.col("source")
    calls = own_turn(t, t.live("api_calls")).withColumn(
        "home", home_key(source, F.col("turn_id"))
    )
    own_calls = calls.select(
        "session_id", key_of("call", source, F.col("id")).alias("key"),
        money(F.coalesce("cost_usd", F.lit(0.0))).alias("own"),
    )
    homes = calls.groupBy("session_id", F.col("home").alias("key")).agg(
        money(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).alias("own")
    )
    idle = t.live("turns").select(
        "session_id", key_of("turn", source, F.col("id")).alias("key"), F.lit(0.0).alias("own")
    )
    idle = idle.join(homes.select("session_id", "key"), ["session_id", "key"], "left_anti")
    runs = run_costs(t).select(
        "session_id", key_of("run", F.col("run_id"), F.col("run_id")).alias("key"),
        F.col("cost_usd").alias("own"),
    )
    loose = (
        spawn_edges(t).filter(F.col("spawn_source").isNull()).select("session_id", "run_id")
        .join(run_costs(t), ["session_id", "run_id"])
        .groupBy("session_id")
        .agg(money(F.sum("cost_usd")).alias("own"))
        .select("session_id", unattached_key(session).alias("key"), "own")
    )
    under = ledger(t)
    tools = (
        t.live("tool_calls").select(*CALL, F.col("id").alias("tool"))
        .join(calls.select(*THREAD, F.col("id").alias("api_call_id"), "cost_usd"), CALL)
        .select(
            "session_id", key_of("tool", source, F.col("tool")).alias("key"),
            money(F.coalesce("cost_usd", F.lit(0.0))).alias("own"),
        )
        .join(under.filter(F.col("under_usd") > 0), ["session_id", "key"], "left_semi")
    )
    spent = reduce(DataFrame.unionByName, [own_calls, homes, idle, runs, loose, tools])
    whole = t.rollups("live").select("session_id", money(F.col("cost_usd")).alias("whole"))
    below = F.coalesce("under_usd", F.lit(0.0))

    def share(cost: Column) -> Column:
        return F.round(cost / F.nullif(F.col("whole"), F.lit(0.0)), 6)

    parts = spent.join(under, ["session_id", "key"], "left").join(whole, "session_id", "left")
    total = F.when((below != 0) & ~F.col("key").startswith("unattached "), money(F.col("own") + below))
    rows = parts.select(
        "session_id", "key", "own", total.alias("total"), share(F.col("own")).alias("share"),
        share(total).alias("total_share"),
    )
    tops = (
        whole.withColumn("key", session_key(session))
        .join(under, ["session_id", "key"], "left")
        .select(
            "session_id", "key", money(F.col("whole") - below).alias("own"),
            F.when(below != 0, F.col("whole")).alias("total"),
            share(F.col("whole") - below).alias("share"),
            F.when((below != 0) & (F.col("whole") != 0), F.lit(1.0)).alias("total_share"),
        )
    )
    return rows.unionByName(tops)
