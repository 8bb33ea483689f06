"""Reports by name: their parameters with types and defaults, and the citation a result carries."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from sessionlake.operators import (
    context,
    corpus,
    gaps,
    listing,
    numbers,
    quality,
    select,
    sheets,
    tree,
)
from sessionlake.operators.relations import Scope, Tables

_MODULES = {
    corpus: (
        "session_counts", "sessions", "tagged_sessions", "weekly_trend", "cost_distribution",
        "session_shapes", "agent_types", "agent_compactions", "tool_failures",
        "error_signatures", "command_failures", "path_failures", "skill_activity",
        "slash_commands", "co_occurrence",
    ),
    gaps: ("context_reloads", "idle_gaps", "reload_cost_split", "missing_file_recovery"),
    select: ("select_sessions", "select_runs", "select_enrichments", "enrichment_coverage"),
    listing: ("project_rollups", "busiest_projects", "session_list", "described_sessions"),
    sheets: (
        "session_overview", "timeline", "error_records", "records_slice", "records_page",
        "record", "enrichment_digest", "enrichment_rows", "session_header", "turn_headers",
        "call_headers", "tool_headers", "run_headers", "run_list", "turn_calls", "call_tools",
        "turn_interjections", "turn_records", "session_errors", "error_steps", "offload_chunk",
        "node_value", "spawn_edges",
    ),
    context: ("turn_bars", "turn_bands", "call_rows", "tool_rows", "compactions"),
    numbers: ("numbers", "compaction_numbers", "tool_numbers"),
    tree: ("nodes", "children", "walk", "titles", "ledger", "node_spend", "hidden_runs"),
    quality: ("unplaceable_content", "duplicate_keys", "gaps_in_index", "foreign_words", "secrets"),
}
REPORTS: dict[str, Callable[..., DataFrame]] = {
    name: getattr(module, name) for module, names in _MODULES.items() for name in names
}


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str
    required: bool
    default: Any


@dataclass(frozen=True)
class Answered:
    """A report's rows, not yet computed, with what was asked."""

    rows: DataFrame
    citation: str


def is_corpus(name: str) -> bool:
    return "scope" in inspect.signature(REPORTS[name]).parameters


def parameters(name: str) -> list[Parameter]:
    """What a report takes besides the relations and the scope."""
    found = []
    for p in inspect.signature(REPORTS[name]).parameters.values():
        if p.name not in ("t", "scope"):
            required = p.default is inspect.Parameter.empty
            found.append(
                Parameter(p.name, str(p.annotation), required, None if required else p.default)
            )
    return found


def run(name: str, t: Tables, scope: Scope | None = None, **bound: Any) -> Answered:
    """A report at its bindings. Unknown or missing parameters are refused before anything runs."""
    if name not in REPORTS:
        raise KeyError(f"no report named {name}")
    declared = {p.name: p for p in parameters(name)}
    unknown = bound.keys() - declared.keys()
    missing = {n for n, p in declared.items() if p.required} - bound.keys()
    if unknown or missing:
        raise TypeError(f"{name}: unknown {sorted(unknown)}, missing {sorted(missing)}")
    values = {n: bound.get(n, p.default) for n, p in declared.items()}
    cited: dict[str, Any] = {}
    args: list[Any] = [t]
    if is_corpus(name):
        if scope is None:
            raise TypeError(f"{name} covers a corpus and needs a scope")
        args.append(scope)
        cited = {
            "project": scope.project, "since": scope.since, "as_of": scope.as_of,
            "window_days": scope.window_days,
        }
    told = " ".join(f"{k}={v}" for k, v in {**cited, **values}.items())
    return Answered(REPORTS[name](*args, **values), f"{name} {told}".strip())
