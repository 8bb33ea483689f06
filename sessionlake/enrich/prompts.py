"""Prompts fitted to their budget, stamped, compared with what is held, and priced."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.enrich.items import (
    Budgets,
    Draft,
    SESSION_TOTAL,
    item_ancestors,
    item_key,
    rounds,
    run_draft,
    session_draft,
    turn_draft,
)
from sessionlake.functions.pricing import MODELS, PER_MILLION
from sessionlake.functions.text import holds_secret
from sessionlake.operators.relations import Tables, describable_sessions
from sessionlake.operators.windows import running
from sessionlake.schema import CATEGORIES, MAIN, OUTCOMES
from sessionlake.session import keep

# What this build writes rows under.
PROMPT_VERSION = {"turn": 4, "agent_run": 4, "session": 4}
TAXONOMY_VERSION = 2
CHARS_PER_TOKEN, OUTPUT_TOKENS, TRANSPORT_TOKENS = 3.3, 230, 700


def elision(gone: int, total: int) -> str:
    return f"[… {gone} of {total} lines elided …]"


def fitted(head: str, first: list[str], last: list[str], total: int, budget: int) -> str:
    """A head and lines of its sequence's two ends, taken in turn while they fit.

    `first` and `last` reach from their end to past anything the budget can hold.
    """
    if len(head) >= budget:
        return head[:budget]
    room = budget - len(head) - 1 - len(elision(total, total)) - 1
    sides = {True: first, False: last}
    taken = {True: 0, False: 0}
    front = True
    while taken[True] + taken[False] < total:
        for side in (front, not front):
            nth = taken[side]
            line = sides[side][nth] if nth < len(sides[side]) else None
            if line is not None and len(line) + 1 <= room:
                room -= len(line) + 1
                taken[side] += 1
                front = not side
                break
        else:
            break
    gone = total - taken[True] - taken[False]
    ends = last[: taken[False]][::-1]
    return "\n".join([head, *first[: taken[True]], elision(gone, total), *ends])


@F.pandas_udf(T.StringType())
def _fit(
    head: pd.Series, first: pd.Series, last: pd.Series, total: pd.Series, budget: pd.Series
) -> pd.Series:
    return pd.Series(
        [
            fitted(h, list(f), list(l), int(n), int(b))
            for h, f, l, n, b in zip(head, first, last, total, budget, strict=True)
        ]
    )


def rendered(draft: Draft, budget: int) -> DataFrame:
    """One prompt per item. Only lines the budget could reach from either end are gathered.

    Lines that fit together are gathered as they are. Among more, a line's distance from the front is
    the length of the lines before it; from the back, of those after. A line too far from both ends
    cannot survive, so an item of any length gathers a bounded text.
    """
    keys = draft.keys
    lines = keep(draft.lines, "prompt_lines")
    cost = (F.length("line") + 1).cast("long")
    totals = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.sum(cost).alias("size")
    )
    whole = F.length("head") + F.coalesce("size", F.lit(0))
    heads = keep(draft.heads.join(totals, keys, "left").withColumn("_whole", whole), "prompt_heads")
    fitting, over = heads.filter(F.col("_whole") <= budget), heads.filter(F.col("_whole") > budget)
    in_order = F.transform(
        F.sort_array(F.collect_list(F.struct("at", "i", "line"))), lambda v: v["line"]
    )
    every = (
        lines.join(fitting.select(*keys), keys, "left_semi").groupBy(*keys).agg(in_order.alias("lines"))
    )
    none = F.array().cast("array<string>")
    short = fitting.join(every, keys, "left").select(
        *keys, F.concat_ws("\n", "head", F.coalesce("lines", none)).alias("prompt")
    )
    placed = running(
        lines.join(over.select(*keys), keys, "left_semi"), keys,
        F.struct("at.o0", "at.o1", F.floor(F.col("at.o2") / 256)), ["at", "i"],
        counts={"nth": F.lit(True)}, sums={"ahead": cost},
    )
    sizes = over.select(*keys, "size").distinct()
    near = placed.join(sizes, keys).withColumn(
        "behind", F.col("size") - F.col("ahead") - cost
    ).filter((F.col("ahead") <= budget) | (F.col("behind") <= budget))
    line = F.struct("nth", "line")

    def gathered(condition: Column, ascending: bool) -> Column:
        kept = F.sort_array(F.collect_list(F.when(condition, line)), asc=ascending)
        return F.transform(kept, lambda v: v["line"])

    ends = near.groupBy(*keys).agg(
        gathered(F.col("ahead") <= budget, True).alias("first"),
        gathered(F.col("behind") <= budget, False).alias("last"),
    )
    long = over.join(ends, keys, "left").select(
        *keys,
        _fit(
            "head", F.coalesce("first", none), F.coalesce("last", none),
            F.coalesce("total", F.lit(0)), F.lit(budget),
        ).alias("prompt"),
    )
    return short.unionByName(long)


def prompts(t: Tables, level: str, budgets: Budgets = Budgets()) -> DataFrame:
    """(session_id, key, prompt) of every item of a level."""
    session = F.col("session_id")
    if level == "turn":
        rows = rendered(turn_draft(t, budgets), budgets.total)
        key = item_key("turn", session, F.lit(MAIN), F.col("turn_id"))
    elif level == "agent_run":
        rows = rendered(run_draft(t, budgets), budgets.total)
        key = item_key("agent_run", session, F.col("run_id"))
    elif level == "session":
        rows = rendered(session_draft(t), min(SESSION_TOTAL, budgets.total))
        key = item_key("session", session)
    else:
        raise ValueError(f"no such level: {level}")
    return rows.select("session_id", F.lit(level).alias("level"), key.alias("key"), "prompt")


def stamped(rows: DataFrame, model: str) -> DataFrame:
    """Prompts with the stamp a row written from them would carry."""
    version = F.create_map(*[F.lit(x) for pair in PROMPT_VERSION.items() for x in pair])
    return rows.withColumns(
        {
            "input_hash": F.sha2("prompt", 256),
            "prompt_version": version[F.col("level")].cast("string"),
            "taxonomy_version": F.lit(str(TAXONOMY_VERSION)), "model": F.lit(model),
        }
    )


_STAMP = ("input_hash", "prompt_version", "taxonomy_version", "model")


def held_stamps(t: Tables) -> DataFrame:
    session = F.col("session_id")
    keys = {
        "turn_enrichments": item_key("turn", session, F.col("source"), F.col("turn_id")),
        "agent_run_enrichments": item_key("agent_run", session, F.col("agent_run_id")),
        "session_enrichments": item_key("session", session),
    }
    return reduce(
        DataFrame.unionByName,
        [t[n].select("session_id", k.alias("key"), *_STAMP) for n, k in keys.items()],
    )


def stale(t: Tables, rows: DataFrame) -> DataFrame:
    """Items whose stored stamp differs from today's, or that have none."""
    held = held_stamps(t).select(
        "session_id", "key", *[F.col(c).alias(f"held_{c}") for c in _STAMP]
    )
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in _STAMP]
    )
    return rows.join(held, ["session_id", "key"], "left").filter(~same).select(*rows.columns)


def outdated(t: Tables) -> DataFrame:
    """Stored rows this build has moved past, judged by their versions alone."""
    level = F.split_part("key", F.lit(" "), F.lit(1))
    version = F.create_map(*[F.lit(x) for pair in PROMPT_VERSION.items() for x in pair])
    moved = (F.col("prompt_version") != version[level].cast("string")) | (
        F.col("taxonomy_version") != str(TAXONOMY_VERSION)
    )
    return held_stamps(t).filter(moved).select(
        "session_id", "key", "prompt_version", "taxonomy_version"
    )


def plan_rejects(t: Tables) -> DataFrame:
    """(session_id, rule, detail): the runs `plan` can never ask, as each waits for itself."""
    return rounds(t)[1]


def plan(
    t: Tables, model: str, failed: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """What a pass would ask now, in order: the stale items and every item that embeds one.

    Runs go leaves first, then turns, then sessions. What embeds a failed item waits. Runs that lie
    above themselves are rows of `plan_rejects`.
    """
    every = stamped(
        reduce(
            DataFrame.unionByName,
            [keep(prompts(t, lv), f"{lv}_prompts") for lv in ("agent_run", "turn", "session")],
        ),
        model,
    )
    moved = keep(stale(t, every).select("session_id", "key"), "stale_items")
    up = item_ancestors(t)
    restated = up.join(moved, ["session_id", "key"], "left_semi").select(
        "session_id", F.col("parent").alias("key")
    )
    asked = every.join(moved.union(restated).distinct(), ["session_id", "key"], "left_semi")
    if failed is not None:
        above = up.join(failed, ["session_id", "key"], "left_semi").select(
            "session_id", F.col("parent").alias("key")
        )
        asked = asked.join(above, ["session_id", "key"], "left_anti")
    heights = keep(rounds(t)[0], "run_rounds")
    rank = F.when(F.col("level") == "agent_run", 0).when(F.col("level") == "turn", 1).otherwise(2)
    placed = heights.select(
        "session_id", item_key("agent_run", F.col("session_id"), F.col("run_id")).alias("key"),
        "round",
    )
    # Only runs have rounds, as many as their longest chain; a run in a ring has none and is not asked.
    ordered = asked.join(placed, ["session_id", "key"], "left").withColumn("level_rank", rank).withColumn(
        "round", F.when(F.col("level_rank") > 0, F.lit(0)).otherwise(F.col("round"))
    ).filter(F.col("round").isNotNull())
    if limit is not None:
        ordered = ordered.orderBy("level_rank", "round", "key").limit(limit)
    return ordered


def quote(rows: DataFrame, model: str, instruction_chars: int = 0) -> DataFrame:
    """What asking a set of prompts would cost at the price of one model."""
    price_in, price_out, _ = MODELS[model]
    sized = rows.agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum(F.length("prompt") + instruction_chars), F.lit(0)).alias("chars"),
    )
    tokens = F.floor(F.col("chars") / F.lit(CHARS_PER_TOKEN)) + F.col("items") * TRANSPORT_TOKENS
    told = F.col("items") * OUTPUT_TOKENS
    return sized.select(
        "items", tokens.alias("input_tokens"), told.alias("output_tokens"),
        ((tokens * F.lit(price_in) + told * F.lit(price_out)) / F.lit(PER_MILLION)).alias("usd"),
    )


ANSWER = "description STRING, category STRING, outcome STRING, friction STRING"


def validated(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): `answers` holds key columns and the answer as JSON text in `answer`."""
    read = answers.withColumn("a", F.from_json("answer", ANSWER))
    typed = F.try_parse_json("answer")

    def is_text(name: str) -> Column:
        member = F.try_variant_get(typed, f"$.{name}", "variant")
        return F.coalesce(F.schema_of_variant(member) == "STRING", F.lit(False))

    def is_absent(name: str) -> Column:
        member = F.try_variant_get(typed, f"$.{name}", "variant")
        return member.isNull() | F.coalesce(F.schema_of_variant(member) == "VOID", F.lit(False))

    said, grief = F.trim("a.description"), F.trim("a.friction")
    failure = (
        F.when(typed.isNull() | ~is_text("description") | (said == ""), "invalid_output")
        .when(~is_text("friction") & ~is_absent("friction"), "invalid_output")
        .when(holds_secret(said) | holds_secret(grief), "secret_shape")
        .when(~F.coalesce(F.col("a.category").isin(*CATEGORIES), F.lit(False)), "invalid_output")
        .when(~F.coalesce(F.col("a.outcome").isin(*OUTCOMES), F.lit(False)), "invalid_output")
    )
    judged = read.withColumn("failure", failure)
    keys = [c for c in answers.columns if c != "answer"]
    good = judged.filter(F.col("failure").isNull()).select(
        *keys, said.alias("description"), F.col("a.category").alias("category"),
        F.col("a.outcome").alias("outcome"), F.nullif(grief, F.lit("")).alias("friction"),
    )
    return good, judged.filter(F.col("failure").isNotNull()).select(*keys, "failure")


def upserted(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Held rows with the new ones in place of those they share a key with."""
    return held.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*held.columns))


def swept(t: Tables) -> dict[str, DataFrame]:
    """Descriptions whose item is still there to describe."""
    turns = t.live("turns").select("session_id", "source", F.col("id").alias("turn_id"))
    runs = t.live("agent_runs").select("session_id", F.col("id").alias("agent_run_id"))
    bases = {
        "turn_enrichments": (turns, ["session_id", "source", "turn_id"]),
        "agent_run_enrichments": (runs, ["session_id", "agent_run_id"]),
        "session_enrichments": (describable_sessions(t), ["session_id"]),
    }
    return {n: t[n].join(base, keys, "left_semi") for n, (base, keys) in bases.items()}
