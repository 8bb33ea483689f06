"""What a transcript carries that nothing declares: kinds of records, and fields at every depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.jsons import read_json
from sessionlake.ingest.records import ARCHIVED_KINDS, PARSED_KINDS, SYSTEM_SUBTYPES, in_map
from sessionlake.operators.windows import THREAD

# The fields declared for each kind of record, and for what records hold. An object that
# is not named here is a leaf: nothing is claimed about its inside.
EVERY = (
    "type sessionId timestamp uuid parentUuid cwd gitBranch version entrypoint isSidechain agentId "
    "userType slug sessionKind session_id forkedFrom isMeta"
)
FIELDS = {
    "user": "message isCompactSummary toolUseResult promptId promptSource origin permissionMode "
    "isVisibleInTranscriptOnly sourceToolAssistantUUID interruptedMessageId thinkingMetadata "
    "sourceToolUseID toolDenialKind userFeedback toolEndsTurn turnCompanion queuePriority "
    "queueSkipAttachments classifierMetaLines imagePasteIds mcpMeta scheduledTaskId scheduledFireId",
    "assistant": "message requestId attributionSkill effort attributionAgent advisorModel "
    "isApiErrorMessage error errorDetails apiErrorStatus apiBlockIndex attributionMcpServer "
    "attributionMcpTool",
    "system": "subtype level content durationMs messageCount pendingBackgroundAgentCount "
    "pendingWorkflowCount compactMetadata logicalParentUuid originalModel fallbackModel choice "
    "persistedAsDefault",
    "custom-title": "customTitle",
    "ai-title": "aiTitle",
    "agent-name": "agentName",
    "pr-link": "prNumber prUrl prRepository",
    "fork-context-ref": "parentSessionId parentLastUuid contextLength agentId",
    "attachment": "attachment rendered renderedInHumanTurn",
}
MESSAGE = {
    "user": "role content",
    "assistant": "role content id model stop_reason usage type stop_sequence stop_details diagnostics "
    "container context_management",
}
USAGE = (
    "input_tokens output_tokens cache_read_input_tokens cache_creation_input_tokens cache_creation "
    "output_tokens_details service_tier speed inference_geo iterations server_tool_use"
)
CACHE = "ephemeral_5m_input_tokens ephemeral_1h_input_tokens"
DETAILS = "thinking_tokens"
ORIGIN = "kind body from name senderTaskId fromMode hopChain msg_id verifiedPeerPid handback"
FORKED = "sessionId messageUuid"
QUEUED = "type prompt commandMode timestamp origin source_uuid isMeta imagePasteIds"
COMPACTED = (
    "trigger preTokens postTokens durationMs cumulativeDroppedTokens preCompactDiscoveredTools "
    "preservedMessages preservedSegment"
)
BLOCKS = {
    "text": "type text",
    "thinking": "type thinking signature",
    "tool_use": "type id name input caller",
    "server_tool_use": "type id name input",
    "advisor_tool_result": "type tool_use_id content",
    "fallback": "type from to",
    "tool_result": "type tool_use_id content is_error",
    "image": "type source",
}


def _odd(path: Column, text: Column, declared: Column) -> Column:
    """Paths of the members of an object that are not declared; none where it is no object."""
    named = F.array_except(F.json_object_keys(text), declared)
    return F.coalesce(F.transform(named, lambda n: F.concat(path, F.lit("."), n)), F.array().cast("array<string>"))


def _words(words: str) -> Column:
    return F.split(F.lit(words), " ")


def unknown_fields(read: DataFrame) -> DataFrame:
    """Fields of the read kinds that no declaration names, by their path and the kind that bears it."""
    kind, raw = F.col("kind"), F.col("raw")
    read = read.filter(kind.isin(*PARSED_KINDS)).withColumns(
        {
            "_in": read_json(raw, ", ".join(f"{n} STRING" for n in ("message", "origin", "attachment", "compactMetadata", "forkedFrom"))),
            "_list": read_json(raw, "message STRUCT<content: ARRAY<STRING>>")["message"]["content"],
        }
    )
    inside = F.col("_in")
    usage = read_json(inside["message"], "usage STRING")["usage"]
    parts = read_json(usage, "cache_creation STRING, output_tokens_details STRING")
    queued = read_json(inside["attachment"], "type STRING, origin STRING")
    is_queued = queued["type"] == "queued_command"

    def below(*names: str) -> Column:
        return F.concat_ws(".", kind, *[F.lit(n) for n in names])

    def in_block(block: Column) -> Column:
        what = read_json(block, "type STRING")["type"]
        declared = F.split(in_map(BLOCKS, what), " ")
        path = F.concat(below("message", "content"), F.lit("."), what)
        return F.when(declared.isNotNull(), _odd(path, block, declared)).otherwise(F.array().cast("array<string>"))

    message = in_map(MESSAGE, kind)
    found = F.concat(
        _odd(kind, raw, F.concat(_words(EVERY), F.split(in_map(FIELDS, kind), " "))),
        F.when(message.isNotNull(), _odd(below("message"), inside["message"], F.split(message, " "))).otherwise(F.array().cast("array<string>")),
        _odd(below("message", "usage"), F.when(kind == "assistant", usage), _words(USAGE)),
        _odd(below("message", "usage", "cache_creation"), F.when(kind == "assistant", parts["cache_creation"]), _words(CACHE)),
        _odd(below("message", "usage", "output_tokens_details"), F.when(kind == "assistant", parts["output_tokens_details"]), _words(DETAILS)),
        _odd(below("origin"), F.when(kind == "user", inside["origin"]), _words(ORIGIN)),
        _odd(below("forkedFrom"), inside["forkedFrom"], _words(FORKED)),
        _odd(below("compactMetadata"), inside["compactMetadata"], _words(COMPACTED)),
        _odd(below("attachment"), F.when(is_queued, inside["attachment"]), _words(QUEUED)),
        _odd(below("attachment", "origin"), F.when(is_queued, queued["origin"]), _words(ORIGIN)),
        F.coalesce(F.flatten(F.transform("_list", in_block)), F.array().cast("array<string>")),
    )
    return tally(read.select(*THREAD, "line_no", F.explode(F.array_distinct(found)).alias("name")))


def unknown_kinds(read: DataFrame) -> DataFrame:
    """Kinds nothing declares: archived all the same, with where each was first seen."""
    subtype = F.col("rec.subtype")
    kind = F.when(
        (F.col("kind") == "system") & ~subtype.isin(*SYSTEM_SUBTYPES),
        F.concat(F.lit("system/"), subtype),
    ).when(~F.col("kind").isin(*PARSED_KINDS, *ARCHIVED_KINDS), F.col("kind"))
    return tally(read.withColumn("name", kind).filter(F.col("name").isNotNull()))


def tally(rows: DataFrame) -> DataFrame:
    """How many lines and sessions bear a name, and where it stands first."""
    first = F.min(F.struct("session_id", "source", "line_no"))
    per_session = rows.groupBy("name", "session_id").agg(
        F.count(F.lit(1)).alias("lines"), first.alias("first")
    )
    return per_session.groupBy("name").agg(
        F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("sessions"),
        F.min("first").alias("first_seen"),
    )
