"""The stored relations: one explicit Spark schema per entity.

A row id is unique only inside its thread, so keys carry (session_id, source, id). `source` names
the thread: `main`, or the id of the agent run that wrote it.
"""

from __future__ import annotations

from pyspark.sql import types as T

MAIN = "main"

_TYPES = {
    "s": T.StringType(),
    "i": T.IntegerType(),
    "l": T.LongType(),
    "d": T.DoubleType(),
    "b": T.BooleanType(),
    "t": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    """`name:type` words; a trailing `?` marks a column that may be NULL."""
    fields = []
    for word in spec.split():
        name, code = word.split(":")
        fields.append(T.StructField(name, _TYPES[code[0]], code.endswith("?")))
    return T.StructType(fields)


ENTITIES: dict[str, T.StructType] = {
    "sessions": _struct(
        "id:s project_dir:s? git_branch:s? version:s? entrypoint:s? started_at:t? ended_at:t? "
        "active_ms:l transcript_path:s title:s? agent_name:s?"
    ),
    "turns": _struct(
        "id:s session_id:s source:s index:i prompt:s command_name:s? command_args:s? "
        "started_at:t ended_at:t replayed:b"
    ),
    "api_calls": _struct(
        "id:s session_id:s source:s turn_id:s? index:i model:s fallback_from:s? effort:s? "
        "stop_reason:s? attribution_skill:s? request_id:s? started_at:t ended_at:t "
        "input_tokens:l output_tokens:l cache_read_tokens:l cache_creation_tokens:l "
        "cache_5m_tokens:l? cache_1h_tokens:l? text:s thinking:s cost_usd:d? synthetic:b replayed:b"
    ),
    "tool_calls": _struct(
        "id:s session_id:s source:s api_call_id:s index:i name:s server_side:b input:s result:s? "
        "offload_file:s? is_error:b incomplete:b started_at:t ended_at:t? duration_synthetic:b "
        "replayed:b"
    ),
    "agent_runs": _struct(
        "id:s session_id:s parent_agent_id:s? tool_use_id:s? agent_type:s brief:s? model:s? "
        "workflow_id:s? spawn_depth:i? is_fork:b fork_context_uuid:s? started_at:t? ended_at:t?"
    ),
    "compactions": _struct(
        "id:s session_id:s source:s timestamp:t trigger:s pre_tokens:l post_tokens:l "
        "duration_ms:l replayed:b"
    ),
    "interjections": _struct(
        "id:s session_id:s source:s turn_id:s? timestamp:t sender:s text:s replayed:b"
    ),
    "pr_links": _struct(
        "session_id:s line_no:i pr_number:i pr_url:s pr_repository:s timestamp:t"
    ),
    "offload_files": _struct("session_id:s name:s content:s lossy_decode:b size_bytes:l"),
    "raw_records": _struct(
        "session_id:s source:s line_no:i uuid:s? timestamp:t? type:s raw:s"
    ),
    "session_tags": _struct("session_id:s key:s value:s"),
    "extract_state": _struct(
        "session_id:s fingerprint:s transcript_path:s extracted_at:t extractor:s "
        "extractor_version:s"
    ),
}

_SAID = (
    "description:s category:s outcome:s friction:s? input_hash:s prompt_version:s "
    "taxonomy_version:s model:s enriched_at:t"
)
ENRICHMENTS: dict[str, T.StructType] = {
    "turn_enrichments": _struct("session_id:s source:s turn_id:s " + _SAID),
    "agent_run_enrichments": _struct("session_id:s agent_run_id:s " + _SAID),
    "session_enrichments": _struct("session_id:s " + _SAID),
}

LEDGERS: dict[str, T.StructType] = {
    "read_positions": _struct("session_id:s source:s file:s bytes:l lines:l"),
    "span_delivery": _struct(
        "session_id:s backend:s fingerprint:s mapper_version:s spans_sent:l delivered_at:t"
    ),
}

# What an archive that keeps itself up holds beside: which ids each session has, which of them an earlier
# session had first, and the counts of each session.
DERIVED: dict[str, T.StructType] = {
    "id_holders": _struct("session_id:s relation:s id:s started_at:t?"),
    "copied_ids": _struct("session_id:s relation:s id:s"),
    "session_rollups": _struct(
        "session_id:s family:s project_dir:s? title:s? started_at:t? ended_at:t? wall_ms:l? active_ms:l? turns:l "
        "api_calls:l tool_calls:l agent_runs:l compactions:l input_tokens:l output_tokens:l cache_read_tokens:l "
        "cache_creation_tokens:l cost_usd:d unpriced_api_calls:l"
    ),
}
RECORDED = {**ENTITIES, **ENRICHMENTS, **LEDGERS}
ALL_TABLES = {**RECORDED, **DERIVED}

# The natural key of each table and the order a session is read back in.
KEYS: dict[str, list[str]] = {
    "sessions": ["id"],
    "turns": ["session_id", "source", "id"],
    "api_calls": ["session_id", "source", "id"],
    "tool_calls": ["session_id", "source", "id"],
    "agent_runs": ["session_id", "id"],
    "compactions": ["session_id", "source", "id"],
    "interjections": ["session_id", "source", "id"],
    "pr_links": ["session_id", "line_no"],
    "offload_files": ["session_id", "name"],
    "raw_records": ["session_id", "source", "line_no"],
    "session_tags": ["session_id", "key"],
    "extract_state": ["session_id"],
    "turn_enrichments": ["session_id", "source", "turn_id"],
    "agent_run_enrichments": ["session_id", "agent_run_id"],
    "session_enrichments": ["session_id"],
    "span_delivery": ["session_id", "backend"],
    "read_positions": ["session_id", "source"],
    "id_holders": ["session_id", "relation", "id"],
    "copied_ids": ["session_id", "relation", "id"],
    "session_rollups": ["session_id", "family"],
}

# Tables a fork may hold copies in, so their rows carry `replayed`. Runs never do.
COUNTED = ["turns", "api_calls", "tool_calls", "agent_runs", "compactions", "interjections"]
SESSION_OWNED = [name for name in ENTITIES if name not in ("sessions", "extract_state")]


def bucket_column(table: str) -> str:
    """What a relation's rows are looked up by: their session, or the id they are held under."""
    return "id" if table == "id_holders" else session_column(table)


def session_column(table: str) -> str:
    return "id" if table == "sessions" else "session_id"


# The closed vocabularies stored rows may use.
CATEGORIES = (
    "design", "implement", "fix_bug", "refactor", "test", "debug", "review",
    "analyze", "document", "configure", "vcs_ops", "explore", "chat", "other",
)
OUTCOMES = ("completed", "partial", "failed", "abandoned", "unclear")
SENDERS = ("person", "agent", "task")
LEVELS = ("turn", "agent_run", "session")
