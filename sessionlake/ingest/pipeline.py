"""Lines of many sessions to the stored relations, in one pass over all of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.ingest import entities, lines as L
from sessionlake.ingest.records import ADVISOR_RESULTS, RESULT_PARTS, odd_kind, parsed
from sessionlake.operators.windows import THREAD
from sessionlake.session import keep


@dataclass
class Extract:
    """What an extract yields: the relations, the sessions withheld and why, the tails dropped."""

    tables: dict[str, DataFrame]
    rejects: DataFrame
    tails: DataFrame
    lines: DataFrame = field(repr=False)


def extract(raw: DataFrame, metas: DataFrame, paths: DataFrame) -> Extract:
    """`raw`: (session_id, source, line_no, raw). `metas`: one row per agent transcript.

    A session any rule rejects is withheld whole; the others are unaffected.
    """
    # What decides between lines is short, so only that is compared and put in order; the lines
    # themselves are dealt out once, unparsed. Parsed where they lie and kept: a dozen relations read them.
    read = keep(L.noted(parsed(raw.filter(F.trim("raw") != ""))), "noted_lines")
    tails, broken = L.unreadable(read)
    whole = read.filter("readable")
    journal = F.col("source").endswith("/journal")
    talk = whole.filter(~journal).drop("raw")
    kept, conflicts = L.resolve_duplicates(talk)
    copies, strays = L.replays(kept, metas)
    marked = L.mark_replays(kept, copies)
    turned = L.assign_turns(marked).select("row", "replayed", "turn_no", "turn_id")
    own = read.select("row", *L.LINE, "raw")
    placed = L.with_prompts(parsed(own.join(turned, "row"))).drop("raw", "odd_tag")
    placed = keep(placed, "placed_lines")
    heard, odd = entities.interjections(placed)
    rejects = reduce(
        DataFrame.unionByName,
        [
            broken, conflicts, strays, L.unknown_tags(marked), odd, L.unknown_blocks(talk),
            missing_fields(placed),
        ],
    )
    rejects = keep(rejects, "rejects")
    bad = keep(rejects.select("session_id").distinct(), "bad_sessions")

    def good(rows: DataFrame) -> DataFrame:
        return rows.join(bad, "session_id", "left_anti")

    sessions = entities.sessions(placed, paths)
    tables = {
        "sessions": sessions.join(bad, sessions["id"] == bad["session_id"], "left_anti"),
        "turns": good(entities.turns(placed)),
        "api_calls": good(entities.api_calls(placed)),
        "tool_calls": good(entities.tool_calls(placed)),
        "agent_runs": good(entities.agent_runs(placed, metas)),
        "compactions": good(entities.compactions(placed)),
        "interjections": good(heard),
        "pr_links": good(entities.pr_links(placed)),
        "raw_records": good(entities.raw_records(whole)),
    }
    return Extract(tables, rejects, tails, placed.join(own.select("row", "raw"), "row").drop("row"))


def missing_fields(placed: DataFrame) -> DataFrame:
    """Records an entity cannot be built without a field of."""
    usage = F.col("rec.message.usage")
    counts = (
        "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"
    )
    unpriced = reduce(lambda a, b: a | b, [usage[c].isNull() for c in counts])
    reply = F.col("kind") == "assistant"
    message = F.col("rec.message")
    rules = {
        "reply without id": reply & message["id"].isNull(),
        "reply without content": reply & F.col("blocks").isNull(),
        "reply without model": reply & message["model"].isNull(),
        "reply without usage": reply & unpriced,
        "reply without time": reply & F.col("ts").isNull(),
        "prompt without uuid or time": F.col("prompt").isNotNull()
        & (F.col("uuid").isNull() | F.col("ts").isNull()),
        "compaction without facts": (F.col("rec.subtype") == "compact_boundary")
        & (
            F.col("rec.compactMetadata").isNull()
            | F.col("rec.compactMetadata.preTokens").isNull()
            | F.col("uuid").isNull()
        ),
        "unknown result part": F.exists(
            "blocks", lambda b: (b["type"] == "tool_result") & odd_kind(b["parts"], RESULT_PARTS)
        ),
        "unknown advisor result": F.exists(
            "blocks",
            lambda b: (b["type"] == "advisor_tool_result")
            & odd_kind(F.array(b["content"]), ADVISOR_RESULTS),
        ),
        "user record without content": (F.col("kind") == "user") & message["content"].isNull(),
    }
    found = F.array_compact(
        F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()])
    )
    return placed.select(
        "session_id", F.explode(found).alias("rule"), L.place("source", "line_no").alias("detail")
    )
