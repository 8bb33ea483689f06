"""The shape of a transcript record, and what an extract recognises in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.jsons import is_object, read_json

# The record kinds read, the kinds kept verbatim only, and the system subtypes.
PARSED_KINDS = (
    "user", "assistant", "system", "custom-title", "ai-title", "agent-name", "pr-link",
    "fork-context-ref", "attachment",
)
ARCHIVED_KINDS = (
    "last-prompt", "mode", "permission-mode", "bridge-session", "file-history-snapshot",
    "file-history-delta", "agent-setting", "cost-state", "atis-latch", "queue-operation",
    "summary", "worktree-state", "relocated", "started", "result", "continued-in",
)
SYSTEM_SUBTYPES = (
    "turn_duration", "compact_boundary", "away_summary", "local_command", "informational",
    "scheduled_task_fire", "api_error", "agents_killed", "stop_hook_summary",
    "model_consent_fallback",
)
BLOCK_KINDS = (
    "text", "thinking", "tool_use", "server_tool_use", "advisor_tool_result", "fallback",
    "image", "tool_result",
)
# What a result in blocks is made of, and what an advisor's answer may be.
RESULT_PARTS = ("text", "image", "tool_reference")
ADVISOR_RESULTS = ("advisor_tool_result_error", "advisor_redacted_result")
# Leading tags that keep a prompt a prompt, and tags written by the machine.
TURN_TAGS = ("command-name", "command-message", "teammate-message")
MACHINE_TAGS = ("task-notification", "local-command-stdout", "bash-stdout", "bash-input")
# Who a mid-turn message may come from, and the lead lines that say so.
SENDER_OF = {"human": "person", "coordinator": "agent", "peer": "agent", "task-notification": "task"}
TASK_MODE = "task-notification"
TASK_TAG = "<task-notification>"
LEADS = {
    "The coordinator sent a message while you were working:": "coordinator",
    "Another Claude session sent a message while you were working:": "peer",
    "The user sent a new message while you were working:": "human",
    "[SYSTEM NOTIFICATION - NOT USER INPUT]": "task-notification",
}
IDLE_LEADS = ("Another Claude session sent a message:",)

RECORD = """
  type STRING, uuid STRING, parentUuid STRING, timestamp STRING, cwd STRING, gitBranch STRING,
  version STRING, entrypoint STRING, isSidechain BOOLEAN, isMeta BOOLEAN,
  isCompactSummary BOOLEAN, subtype STRING, durationMs BIGINT, requestId STRING, effort STRING,
  attributionSkill STRING, customTitle STRING, aiTitle STRING, agentName STRING, prNumber INT,
  prUrl STRING, prRepository STRING, parentLastUuid STRING, origin STRUCT<kind: STRING>,
  attachment STRUCT<type: STRING, commandMode: STRING, prompt: STRING, origin: STRUCT<kind: STRING>>,
  compactMetadata STRUCT<trigger: STRING, preTokens: BIGINT, postTokens: BIGINT, durationMs: BIGINT>,
  message STRUCT<id: STRING, model: STRING, stop_reason: STRING, content: STRING,
    usage: STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, cache_read_input_tokens: BIGINT,
      cache_creation_input_tokens: BIGINT,
      cache_creation: STRUCT<ephemeral_5m_input_tokens: BIGINT, ephemeral_1h_input_tokens: BIGINT>>>
"""
DETAILS = "toolUseResult STRUCT<persistedOutputPath: STRING, runId: STRING>"
# The same field read a second way: NULL unless it holds a list, whose members stay text.
LISTS = (
    "message STRUCT<content: ARRAY<STRING>>, attachment STRUCT<prompt: ARRAY<STRING>>"
)
BLOCK = """
  type STRING, id STRING, name STRING, input STRING, text STRING, thinking STRING,
  tool_use_id STRING, is_error BOOLEAN, content STRING, `from` STRUCT<model: STRING>
"""
# A block's content read a second way: NULL unless it is a list.
PARTS = "content ARRAY<STRING>"
PART = "type STRING, text STRING"
META = (
    "agentType STRING, description STRING, model STRING, toolUseId STRING, parentAgentId STRING, "
    "spawnDepth INT, isFork BOOLEAN"
)


def parsed(lines: DataFrame) -> DataFrame:
    """Raw lines with their record beside them; a line that is not a JSON object has none."""
    raw = F.col("raw")
    whole = is_object(raw)
    rec = F.when(whole, read_json(raw, RECORD))
    lists = F.when(whole, read_json(raw, LISTS))
    return (
        lines.withColumns({"rec": rec, "_lists": lists, "_details": read_json(raw, DETAILS)})
        .withColumns(
            {
                "ts": F.try_to_timestamp(F.col("rec.timestamp")),
                "blocks": F.transform(
                    F.col("_lists.message.content"),
                    lambda b: read_json(b, BLOCK).withField("parts", read_json(b, PARTS)["content"]),
                ),
                "prompt_parts": F.transform(
                    F.col("_lists.attachment.prompt"), lambda b: read_json(b, PART)
                ),
                "details": F.col("_details.toolUseResult"),
                "uuid": F.col("rec.uuid"),
                "kind": F.col("rec.type"),
            }
        )
        .drop("_lists", "_details")
    )


def text_of(block: Column) -> Column:
    """A result as text: a string as it stands, whatever it looks like; a list as its text parts
    joined."""
    texts = F.filter(
        F.transform(block["parts"], lambda p: read_json(p, PART)), lambda p: p["type"] == "text"
    )
    joined = F.array_join(F.transform(texts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.when(block["parts"].isNotNull(), joined).otherwise(block["content"])


def odd_kind(members: Column, kinds: tuple[str, ...]) -> Column:
    """Whether a list of objects has one of another kind; not where there is no list."""
    kind = lambda m: F.coalesce(read_json(m, "type STRING")["type"], F.lit(""))
    return F.coalesce(F.exists(members, lambda m: ~kind(m).isin(*kinds)), F.lit(False))


def words_of(blocks: Column, kind: str, member: str) -> Column:
    """Every block of one kind in a record, its words joined in order."""
    return F.array_join(
        F.transform(
            F.filter(blocks, lambda b: b["type"] == kind),
            lambda b: F.coalesce(b[member], F.lit("")),
        ),
        "",
    )


def in_map(pairs: dict[str, str], key: Column) -> Column:
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)
