"""Sessions as trace spans: one row per span, parents resolved, ready for any tracing sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.ingest.lines import reject
from sessionlake.operators.relations import Tables
from sessionlake.operators.tree import ancestors
from sessionlake.operators.windows import THREAD
from sessionlake.schema import MAIN

DELIMITER = "/"
MAPPER_VERSION = "1"
BATCH_SPANS = 2_000
MIN_DURATION_US = 1_000
SESSION_SPAN = "session"
COMPACTION_SPAN = "compaction"


def trace_id(session: Column) -> Column:
    return F.substring(F.sha2(session, 256), 1, 32)


def span_id(session: Column, kind: str, source: Column, ident: Column) -> Column:
    """Eight bytes of a digest over the row's whole key."""
    return F.substring(
        F.sha2(F.concat_ws(DELIMITER, session, F.lit(kind), source, ident), 256), 1, 16
    )


def ambiguous_keys(t: Tables) -> DataFrame:
    """Ids holding the delimiter a span id is joined with: two keys could read as one."""

    def odd(table: str, *columns: str) -> DataFrame:
        held = [F.contains(F.col(c), F.lit(DELIMITER)) for c in columns]
        bad = reduce(lambda a, b: a | b, held)
        return reject(t.live(table).filter(bad), "delimiter in an id", F.concat_ws(" ", *columns))

    return reduce(
        DataFrame.unionByName,
        [odd(n, "session_id", "source", "id") for n in
         ("turns", "api_calls", "tool_calls", "compactions")]
        + [odd("agent_runs", "session_id", "id")],
    )


def unplaceable_sessions(t: Tables) -> DataFrame:
    """Sessions no trace can hold: without times there is no root, without a project no service."""
    timeless = F.col("started_at").isNull() | F.col("ended_at").isNull()
    s = t["sessions"].withColumnRenamed("id", "session_id")
    untimed = reject(s.filter(timeless), "session without times", F.col("session_id"))
    unplaced = reject(
        s.filter(F.col("project_dir").isNull()), "session without project", F.col("session_id")
    )
    runs = t.live("agent_runs")
    idle = reject(runs.filter(timeless), "run without times", F.col("id"))
    return untimed.unionByName(unplaced).unionByName(idle)


def unparented_calls(t: Tables) -> DataFrame:
    """Calls naming a turn their own thread does not hold."""
    turns = t["turns"].select(*THREAD, F.col("id").alias("turn_id"))
    named = t.live("api_calls").filter(F.col("turn_id").isNotNull())
    return reject(
        named.join(turns, [*THREAD, "turn_id"], "left_anti"), "call under no held turn",
        F.concat_ws(" ", "source", "id"),
    )


def resources(t: Tables, service_name: str | None = None) -> DataFrame:
    """What every span of a session is attributed to: its project folder's name, unless told."""
    named = F.element_at(F.split(F.col("project_dir"), "/", -1), -1)
    service = F.lit(service_name) if service_name is not None else named
    return t["sessions"].filter(service.isNotNull()).select(
        F.col("id").alias("session_id"), service.alias("service_name"),
        F.lit(MAPPER_VERSION).alias("mapper_version"),
    )


def _source_parent(session: Column, source: Column) -> Column:
    none = F.lit("")
    return F.when(source == MAIN, span_id(session, "session", none, session)).otherwise(
        span_id(session, "agent_run", none, source)
    )


def _attributes(**members: Column) -> Column:
    """Only the attributes that hold something."""
    pairs = [x for name, value in members.items() for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _yes(flag: Column) -> Column:
    return F.when(flag, F.lit("true"))


def spans(t: Tables, include_text: bool = False, max_chars: int = 1_000) -> DataFrame:
    """Every span of every session that can be traced. A fork's copies emit nothing.

    A tool call that started a run is that run's span. A run hangs off the call that asked for it,
    except where that call lies inside the run itself: then off the parent it records.
    """
    session, source, ident = F.col("session_id"), F.col("source"), F.col("id")
    none = F.lit("")
    root = span_id(session, "session", none, session)

    def text(column: str) -> Column:
        value = F.col(column)
        return F.substring(value, 1, max_chars) if include_text else F.lit(None).cast("string")

    withheld = unplaceable_sessions(t).select("session_id").distinct()

    def traced(rows: DataFrame) -> DataFrame:
        return rows.join(withheld, "session_id", "left_anti")

    def shape(rows: DataFrame, kind: str, sid: Column, parent: Column, name: Column,
              end: Column, attributes: Column) -> DataFrame:
        return rows.select(
            "session_id", trace_id(session).alias("trace_id"), sid.alias("span_id"),
            parent.alias("parent_span_id"), F.lit(kind).alias("kind"), name.alias("name"),
            F.col("started_at"),
            F.timestamp_micros(
                F.greatest(F.unix_micros(end), F.unix_micros("started_at") + MIN_DURATION_US)
            ).alias("ended_at"),
            attributes.alias("attributes"),
        )

    turns = shape(
        traced(t.live("turns")), "turn", span_id(session, "turn", source, ident),
        _source_parent(session, source), F.lit("turn"), F.col("ended_at"),
        _attributes(index=F.col("index"), source=source, command_name=F.col("command_name"),
                    prompt=text("prompt"), command_args=text("command_args")),
    )
    held = t["turns"].select(
        *THREAD, F.col("id").alias("turn_id"), F.col("replayed").alias("_copied")
    )
    own = F.col("_copied").isNotNull() & ~F.col("_copied")
    chats = shape(
        traced(t.live("api_calls").join(held, [*THREAD, "turn_id"], "left")), "chat",
        span_id(session, "api_call", source, ident),
        F.when(own, span_id(session, "turn", source, F.col("turn_id"))).otherwise(
            _source_parent(session, source)
        ),
        F.concat(F.lit("chat "), "model"), F.col("ended_at"),
        _attributes(
            model=F.col("model"), input_tokens=F.col("input_tokens"),
            output_tokens=F.col("output_tokens"), stop_reason=F.col("stop_reason"),
            cache_read_tokens=F.col("cache_read_tokens"),
            cache_creation_tokens=F.col("cache_creation_tokens"), source=source,
            effort=F.col("effort"), fallback_from=F.col("fallback_from"),
            attribution_skill=F.col("attribution_skill"), request_id=F.col("request_id"),
            cost_usd=F.col("cost_usd"), synthetic=_yes(F.col("synthetic")), text=text("text"),
            thinking=text("thinking"),
        ),
    )
    runs = t.live("agent_runs")
    launched = runs.filter(F.col("tool_use_id").isNotNull()).select(
        "session_id", F.col("tool_use_id").alias("id")
    ).distinct()
    tools = shape(
        traced(t.live("tool_calls").join(launched, ["session_id", "id"], "left_anti")), "tool",
        span_id(session, "tool_call", source, ident),
        span_id(session, "api_call", source, F.col("api_call_id")),
        F.concat(F.lit("execute_tool "), "name"), F.coalesce("ended_at", "started_at"),
        _attributes(
            name=F.col("name"), source=source, index=F.col("index"),
            server_side=_yes(F.col("server_side")),
            duration_synthetic=_yes(F.col("duration_synthetic")),
            is_error=_yes(F.col("is_error")), offload_file=F.col("offload_file"),
            incomplete=_yes(F.col("ended_at").isNull()), input=text("input"),
            result=text("result"),
        ),
    )
    agents = shape(
        traced(_placed_runs(t)), "run", span_id(session, "agent_run", none, ident),
        F.when(F.col("at").isNull(), root)
        .when(
            F.col("inside"),
            _source_parent(session, F.coalesce("parent_agent_id", F.lit(MAIN))),
        )
        .otherwise(span_id(session, "api_call", F.col("at"), F.col("at_call"))),
        F.concat(F.lit("invoke_agent "), "agent_type"), F.col("ended_at"),
        _attributes(
            agent_type=F.col("agent_type"), parent_agent_id=F.col("parent_agent_id"),
            tool_use_id=F.col("tool_use_id"), model=F.col("model"),
            workflow_id=F.col("workflow_id"), spawn_depth=F.col("spawn_depth"),
            is_fork=_yes(F.col("is_fork")), brief=text("brief"), orphan=_yes(F.col("at").isNull()),
        ),
    )
    marks = t.live("compactions").withColumn("started_at", F.col("timestamp"))
    compactions = shape(
        traced(marks), "compaction", span_id(session, "compaction", source, ident),
        _source_parent(session, source), F.lit(COMPACTION_SPAN),
        F.timestamp_micros(F.unix_micros("timestamp") + F.col("duration_ms") * 1000),
        _attributes(source=source, trigger=F.col("trigger"), pre_tokens=F.col("pre_tokens"),
                    post_tokens=F.col("post_tokens")),
    )
    children = reduce(DataFrame.unionByName, [turns, chats, tools, agents, compactions])
    # A run can outlive the main transcript: the root lasts until its last child ends.
    latest = children.groupBy("session_id").agg(F.max("ended_at").alias("latest"))
    whole = (
        traced(t["sessions"].withColumnRenamed("id", "session_id"))
        .join(latest, "session_id", "left")
    )
    roots = shape(
        whole, "session", root, F.lit(""), F.lit(SESSION_SPAN),
        F.greatest("ended_at", "latest"),
        _attributes(
            version=F.col("version"), entrypoint=F.col("entrypoint"),
            project_dir=F.col("project_dir"), git_branch=F.col("git_branch"),
            active_ms=F.col("active_ms"), title=text("title"), agent_name=text("agent_name"),
        ),
    )
    return roots.unionByName(children)


def _placed_runs(t: Tables) -> DataFrame:
    """Runs with the thread and call that asked, and whether that call lies inside the run."""
    tools = t.live("tool_calls").select(
        "session_id", F.col("id").alias("tool_use_id"),
        F.struct(F.col("source").alias("at"), F.col("api_call_id").alias("at_call")).alias("_by"),
    ).groupBy("session_id", "tool_use_id").agg(F.max("_by").alias("_by"))
    runs = t.live("agent_runs")
    lineage = ancestors(
        runs.filter(F.col("parent_agent_id").isNotNull()).select(
            "session_id", "id", F.col("parent_agent_id").alias("above")
        ),
        ["session_id"], "id", "above",
    )
    under = lineage.select(
        "session_id", F.col("id").alias("at"), F.col("above").alias("id"), F.lit(True).alias("_under")
    )
    placed = runs.join(tools, ["session_id", "tool_use_id"], "left").select(
        *runs.columns, "_by.at", "_by.at_call"
    )
    return placed.join(under, ["session_id", "at", "id"], "left").withColumn(
        "inside", F.coalesce("_under", F.lit(False)) | F.coalesce(F.col("at") == F.col("id"), F.lit(False))
    )


def pr_events(t: Tables, include_text: bool = False, max_chars: int = 1_000) -> DataFrame:
    """Pull requests a session touched: instants on its root span."""

    def text(column: str) -> Column:
        return F.substring(F.col(column), 1, max_chars) if include_text else F.lit(None)

    return t["pr_links"].select(
        "session_id",
        span_id(F.col("session_id"), "session", F.lit(""), F.col("session_id")).alias("span_id"),
        F.col("timestamp").alias("at"), F.lit("pr_link").alias("name"),
        _attributes(number=F.col("pr_number"), url=text("pr_url"),
                    repository=text("pr_repository")).alias("attributes"),
    )
