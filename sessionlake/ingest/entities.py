"""The stored entities, built from lines that count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake import schema
from sessionlake.functions.pricing import SYNTHETIC, compute_cost
from sessionlake.ingest.lines import place, reject
from sessionlake.ingest.records import (
    IDLE_LEADS,
    LEADS,
    SENDER_OF,
    TASK_MODE,
    TASK_TAG,
    in_map,
    text_of,
    words_of,
)
from sessionlake.operators.windows import THREAD, block_of, running
from sessionlake.schema import MAIN

MESSAGE = [*THREAD, "message_id"]


def shaped(rows: DataFrame, table: str) -> DataFrame:
    """Exactly the stored columns of a table, in its types."""
    return rows.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.ALL_TABLES[table].fields]
    )


def raw_records(lines: DataFrame) -> DataFrame:
    return shaped(
        lines.select(*THREAD, "line_no", "uuid", F.col("ts").alias("timestamp"),
                     F.col("kind").alias("type"), "raw"),
        "raw_records",
    )


def turns(lines: DataFrame) -> DataFrame:
    """A turn runs to the next prompt; it ends at the latest time recorded in between."""
    ended = lines.filter(F.col("turn_id").isNotNull()).groupBy(*THREAD, "turn_id").agg(
        F.max("ts").alias("ended_at")
    )
    opened = lines.filter(F.col("prompt").isNotNull()).select(
        *THREAD, "turn_id", F.col("uuid").alias("id"), F.col("turn_no").alias("index"), "prompt",
        "command_name", "command_args", F.col("ts").alias("started_at"), "replayed",
    )
    return shaped(opened.join(ended, [*THREAD, "turn_id"]), "turns")


def replies(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("kind") == "assistant").withColumn(
        "message_id", F.col("rec.message.id")
    )


def api_calls(lines: DataFrame) -> DataFrame:
    """One call per reply, however many records it was written across.

    What a reply turned out to be is on its last record; where it belongs is on its first.
    """
    usage = F.col("rec.message.usage")
    last = F.struct(
        F.col("rec.message.model").alias("model"), F.col("rec.message.stop_reason").alias("stop"),
        "rec.effort", "rec.attributionSkill", "rec.requestId", "ts", usage.alias("usage"),
    )
    first = F.struct("turn_id", "ts", "rec.parentUuid", "replayed")
    asked = F.filter("blocks", lambda b: b["type"] == "fallback")
    chunk = F.struct(
        "line_no", words_of(F.col("blocks"), "text", "text").alias("text"),
        words_of(F.col("blocks"), "thinking", "thinking").alias("thinking"),
    )
    chunks = F.sort_array(F.collect_list(chunk))

    def joined(member: str) -> Column:
        return F.array_join(F.transform(chunks, lambda c: c[member]), "")

    grouped = replies(lines).groupBy(*MESSAGE).agg(
        F.min("line_no").alias("first_no"),
        F.max_by(last, "line_no").alias("last"), F.min_by(first, "line_no").alias("first"),
        joined("text").alias("text"), joined("thinking").alias("thinking"),
        F.min_by(
            F.get(asked, F.lit(0))["from"]["model"],
            F.when(F.size(asked) > 0, F.col("line_no")),
        ).alias("fallback_from"),
    )
    answered = lines.filter(F.col("uuid").isNotNull()).select(
        *THREAD, F.col("uuid").alias("parent"), F.col("ts").alias("asked_at")
    )
    placed = grouped.withColumn("parent", F.col("first.parentUuid")).join(
        answered, [*THREAD, "parent"], "left"
    )
    numbered = running(
        placed, THREAD, block_of(F.col("first_no")), ["first_no"], counts={"index": F.lit(True)}
    )
    u = F.col("last.usage")
    tokens = {
        "input_tokens": u["input_tokens"], "output_tokens": u["output_tokens"],
        "cache_read_tokens": u["cache_read_input_tokens"],
        "cache_creation_tokens": u["cache_creation_input_tokens"],
        "cache_5m_tokens": u["cache_creation"]["ephemeral_5m_input_tokens"],
        "cache_1h_tokens": u["cache_creation"]["ephemeral_1h_input_tokens"],
    }
    model = F.col("last.model")
    return shaped(
        numbered.select(
            *THREAD, F.col("message_id").alias("id"), F.col("first.turn_id").alias("turn_id"),
            "index", model.alias("model"), "fallback_from", F.col("last.effort").alias("effort"),
            F.col("last.stop").alias("stop_reason"),
            F.col("last.attributionSkill").alias("attribution_skill"),
            F.col("last.requestId").alias("request_id"),
            F.coalesce("asked_at", "first.ts").alias("started_at"),
            F.col("last.ts").alias("ended_at"), *[c.alias(n) for n, c in tokens.items()],
            "text", "thinking", compute_cost(model, *tokens.values()).alias("cost_usd"),
            (model == SYNTHETIC).alias("synthetic"), F.col("first.replayed").alias("replayed"),
        ),
        "api_calls",
    )


def _results(lines: DataFrame) -> DataFrame:
    """What each tool said back: the later record wins, a server's own answer over a local one."""
    local = (
        lines.filter(F.col("kind") == "user")
        .select(*THREAD, "line_no", "ts", "details", F.posexplode("blocks").alias("pos", "b"))
        .filter(F.col("b.type") == "tool_result")
        .select(
            *THREAD, F.col("b.tool_use_id").alias("id"),
            F.struct(F.lit(0).alias("server"), "line_no", "pos").alias("order"),
            F.struct(
                text_of(F.col("b")).alias("text"),
                F.coalesce(F.col("b.is_error"), F.lit(False)).alias("is_error"),
                F.element_at(F.split(F.col("details.persistedOutputPath"), "/", -1), -1)
                .alias("offload_file"),
                F.col("ts").alias("ended_at"),
            ).alias("said"),
        )
    )
    advice = F.from_json(F.col("b.content"), "type STRING, error_code STRING")
    refused = F.col("a.type") == "advisor_tool_result_error"
    server = (
        replies(lines)
        .select(*THREAD, "line_no", "ts", F.posexplode("blocks").alias("pos", "b"))
        .filter(F.col("b.type") == "advisor_tool_result")
        .withColumn("a", advice)
        .select(
            *THREAD, F.col("b.tool_use_id").alias("id"),
            F.struct(F.lit(1).alias("server"), "line_no", "pos").alias("order"),
            F.struct(
                F.when(refused, F.col("a.error_code")).alias("text"),
                F.coalesce(refused, F.lit(False)).alias("is_error"),
                F.lit(None).cast("string").alias("offload_file"), F.col("ts").alias("ended_at"),
            ).alias("said"),
        )
    )
    return local.unionByName(server).groupBy(*THREAD, "id").agg(
        F.max_by("said", "order").alias("said")
    )


def tool_calls(lines: DataFrame) -> DataFrame:
    """Every tool asked for with what came back. Tools of one reply share their earliest start."""
    issued = (
        replies(lines)
        .select(*MESSAGE, "line_no", "ts", "replayed", F.posexplode("blocks").alias("pos", "b"))
        .filter(F.col("b.type").isin("tool_use", "server_tool_use"))
        .select(
            *MESSAGE, "line_no", "ts", "replayed", "pos", F.col("b.id").alias("id"),
            F.col("b.name").alias("name"), F.col("b.input").alias("input"),
            (F.col("b.type") == "server_tool_use").alias("server_side"),
        )
    )
    batch = issued.filter(~F.col("server_side")).groupBy(*MESSAGE).agg(
        F.min("ts").alias("batch_start"), F.min("line_no").alias("lo"),
        F.max("line_no").alias("hi"),
    )
    numbered = running(
        issued, THREAD, block_of(F.col("line_no")), ["line_no", "pos"],
        counts={"index": F.lit(True)},
    )
    joined = numbered.join(batch, MESSAGE, "left").join(_results(lines), [*THREAD, "id"], "left")
    local = ~F.col("server_side")
    return shaped(
        joined.select(
            *THREAD, "id", F.col("message_id").alias("api_call_id"), "index",
            "name", "server_side", "input",
            F.col("said.text").alias("result"), F.col("said.offload_file").alias("offload_file"),
            F.coalesce("said.is_error", F.lit(False)).alias("is_error"),
            F.col("said").isNull().alias("incomplete"),
            F.when(local, F.col("batch_start")).otherwise(F.col("ts")).alias("started_at"),
            F.col("said.ended_at").alias("ended_at"),
            # Several records issued the batch exactly when its first and last line differ.
            (local & (F.col("lo") != F.col("hi"))).alias("duration_synthetic"), "replayed",
        ),
        "tool_calls",
    )


def compactions(lines: DataFrame) -> DataFrame:
    meta = F.col("rec.compactMetadata")
    rows = lines.filter(
        (F.col("kind") == "system") & (F.col("rec.subtype") == "compact_boundary")
    )
    return shaped(
        rows.select(
            F.col("uuid").alias("id"), *THREAD, F.col("ts").alias("timestamp"),
            meta["trigger"].alias("trigger"), meta["preTokens"].alias("pre_tokens"),
            meta["postTokens"].alias("post_tokens"), meta["durationMs"].alias("duration_ms"),
            "replayed",
        ),
        "compactions",
    )


def interjections(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mid-turn messages, those that contradict themselves).

    A message arrives queued as an attachment, or relayed as a machine user record whose lead line
    must agree with the sender it names.
    """
    queued = (F.col("kind") == "attachment") & (F.col("rec.attachment.type") == "queued_command")
    relayed = (
        (F.col("kind") == "user")
        & F.coalesce(F.col("rec.isMeta"), F.lit(False))
        & F.col("rec.origin").isNotNull()
    )
    content = F.col("rec.message.content")
    lead = F.split_part(content, F.lit("\n"), F.lit(1))
    body = F.substr(content, F.length(lead) + 2)
    expected = in_map(LEADS, lead)
    idle = lead.isin(*IDLE_LEADS)
    at = F.locate(TASK_TAG, body)
    queued_from = F.when(
        F.col("rec.attachment.commandMode") == TASK_MODE, F.lit("task")
    ).otherwise(in_map(SENDER_OF, F.col("rec.attachment.origin.kind")))
    queued_text = F.when(
        F.col("prompt_parts").isNotNull(),
        F.array_join(
            F.transform(
                "prompt_parts",
                lambda p: F.when(p["type"] == "image", F.lit("[image]")).otherwise(p["text"]),
            ),
            "\n\n",
        ),
    ).otherwise(F.col("rec.attachment.prompt"))
    relayed_from = in_map(SENDER_OF, expected)
    relayed_text = F.when(relayed_from == "task", F.substr(body, at)).otherwise(body)
    heard = lines.filter(queued | (relayed & ~idle))
    rows = heard.select(
        F.col("uuid").alias("id"), *THREAD, "line_no", "turn_id", F.col("ts").alias("timestamp"),
        F.when(queued, queued_from).otherwise(relayed_from).alias("sender"),
        F.when(queued, queued_text).otherwise(relayed_text).alias("text"), "replayed",
        (relayed & (~F.col("rec.origin.kind").eqNullSafe(expected)
                    | ((relayed_from == "task") & (at == 0)))).alias("_odd"),
    )
    odd = F.col("sender").isNull() | F.coalesce("_odd", F.lit(True))
    errors = reject(rows.filter(odd), "interjection sender", place("source", "line_no"))
    return shaped(rows.filter(~odd), "interjections"), errors


def pr_links(lines: DataFrame) -> DataFrame:
    rows = lines.filter((F.col("kind") == "pr-link") & (F.col("source") == MAIN))
    return shaped(
        rows.select(
            "session_id", "line_no", F.col("rec.prNumber").alias("pr_number"),
            F.col("rec.prUrl").alias("pr_url"), F.col("rec.prRepository").alias("pr_repository"),
            F.col("ts").alias("timestamp"),
        ),
        "pr_links",
    )


def sessions(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """A session's header off its main transcript: first place, first and last time, last title."""
    main = lines.filter(F.col("source") == MAIN)
    no = F.col("line_no")

    def last(kind: str, member: str) -> Column:
        return F.max_by(F.col(f"rec.{member}"), F.when(F.col("kind") == kind, no)).alias(member)

    site = F.struct("rec.cwd", "rec.gitBranch", "rec.version", "rec.entrypoint")
    sited = F.col("rec.cwd").isNotNull()
    duration = (F.col("kind") == "system") & (F.col("rec.subtype") == "turn_duration")
    rows = main.groupBy("session_id").agg(
        F.min_by(site, F.when(sited, no)).alias("site"), F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.coalesce(F.sum(F.when(duration, F.col("rec.durationMs"))), F.lit(0)).alias("active_ms"),
        last("custom-title", "customTitle"), last("ai-title", "aiTitle"),
        last("agent-name", "agentName"),
    )
    named = F.when(F.col("customTitle") != "", F.col("customTitle"))
    written = F.when(F.col("aiTitle") != "", F.col("aiTitle"))
    return shaped(
        rows.join(paths, "session_id").select(
            F.col("session_id").alias("id"), F.col("site.cwd").alias("project_dir"),
            F.col("site.gitBranch").alias("git_branch"), F.col("site.version").alias("version"),
            F.col("site.entrypoint").alias("entrypoint"), "started_at", "ended_at", "active_ms",
            "transcript_path", F.coalesce(named, written).alias("title"),
            F.col("agentName").alias("agent_name"),
        ),
        "sessions",
    )


def workflow_launches(lines: DataFrame) -> DataFrame:
    """Which call launched each fan-out: the run id its result names, to the call's id."""
    rows = lines.filter(
        (F.col("kind") == "user") & F.col("details.runId").isNotNull() & (F.col("source") == MAIN)
    )
    answered = F.filter("blocks", lambda b: b["type"] == "tool_result")
    return (
        rows.select(
            "session_id", F.col("details.runId").alias("workflow_id"), "line_no",
            F.element_at(answered, -1)["tool_use_id"].alias("launch_id"),
        )
        .groupBy("session_id", "workflow_id")
        .agg(F.max_by("launch_id", "line_no").alias("launch_id"))
    )


def agent_runs(lines: DataFrame, metas: DataFrame) -> DataFrame:
    """One run per sub-agent, from the description beside its transcript and its own lines."""
    forked = (F.col("kind") == "fork-context-ref") & F.col("rec.parentLastUuid").isNotNull()
    spans = (
        lines.groupBy("session_id", F.col("source").alias("agent_id"))
        .agg(
            F.min(F.when(~F.col("replayed"), F.col("ts"))).alias("started_at"),
            F.max("ts").alias("ended_at"),
            F.min_by("rec.parentLastUuid", F.when(forked, F.col("line_no")))
            .alias("fork_context_uuid"),
        )
    )
    rows = (
        metas.join(spans, ["session_id", "agent_id"], "left")
        .join(workflow_launches(lines), ["session_id", "workflow_id"], "left")
    )
    return shaped(
        rows.select(
            F.col("agent_id").alias("id"), "session_id",
            F.col("parentAgentId").alias("parent_agent_id"),
            F.coalesce(F.when(F.col("toolUseId") != "", F.col("toolUseId")), F.col("launch_id"))
            .alias("tool_use_id"),
            F.col("agentType").alias("agent_type"), F.col("description").alias("brief"), "model",
            "workflow_id", F.col("spawnDepth").alias("spawn_depth"),
            F.coalesce("isFork", F.lit(False)).alias("is_fork"), "fork_context_uuid",
            "started_at", "ended_at",
        ),
        "agent_runs",
    )
