"""Deterministic draws: which sessions, runs and described items a reader should look at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlake.operators.corpus import money, runs_with_spend
from sessionlake.operators.relations import Scope, Tables, by_period, project_sessions
from sessionlake.schema import MAIN
from sessionlake.session import keep

DRAW_SEED = "1"


def drawn_by(key: Column, seed: str) -> Column:
    """A position anyone can recompute: the digest of the key and the seed."""
    return F.md5(F.concat(key, F.lit(seed)))


def _first(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in order with their rank: a distributed top-k, then ranks over the few kept."""
    return rows.orderBy(*order).limit(limit).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order))
    )


def session_pool(t: Tables, scope: Scope, min_api_calls: int) -> DataFrame:
    """In-window sessions that did work of their own."""
    held = project_sessions(t, scope).filter("in_window").select("session_id")
    errors = (
        t.corpus("tool_calls")
        .filter("is_error")
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("tool_errors"))
    )
    return (
        t.rollups("corpus")
        .join(held, "session_id", "left_semi")
        .join(errors, "session_id", "left")
        .filter(
            ((F.col("turns") > 0) | (F.col("agent_runs") > 0))
            & (F.col("api_calls") >= min_api_calls)
        )
        .select(
            "session_id", "started_at", "turns", "api_calls", "agent_runs", "tool_calls",
            F.coalesce("tool_errors", F.lit(0)).alias("tool_errors"), "compactions", "cost_usd",
            "unpriced_api_calls",
        )
    )


def select_sessions(
    t: Tables,
    scope: Scope,
    cost_quota: int = 8,
    error_quota: int = 5,
    compaction_quota: int = 4,
    discovery_quota: int = 8,
    skill_threshold: int = 5,
    seed: str = DRAW_SEED,
    min_api_calls: int = 1,
    min_discovery_api_calls: int = 10,
) -> DataFrame:
    """A stratified reading set: costliest, most errors, most compactions, one per major skill, rest.

    Strata draw in turn, each the first few of what those before it left, and what they leave of the
    budget goes to discovery. Skills draw together: see `matched`.
    """
    # One narrow row per session of the window, ranked several ways: kept rather than recomputed.
    pool = keep(session_pool(t, scope, min_api_calls), "session_pool")
    users = keep(
        t.corpus("api_calls")
        .filter(F.col("attribution_skill").isNotNull())
        .select("session_id", F.col("attribution_skill").alias("skill"))
        .distinct()
        .join(pool.select("session_id", "started_at"), "session_id"),
        "skill_users",
    )
    major = keep(
        users.groupBy("skill").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= skill_threshold), "skills"
    )
    skills = major.count()
    # The budget grows with the number of major skills, which is only known by counting them.
    total = cost_quota + error_quota + compaction_quota + discovery_quota + skills
    drawn: list[DataFrame] = []

    def left(rows: DataFrame) -> DataFrame:
        for earlier in drawn:
            rows = rows.join(earlier.select("session_id"), "session_id", "left_anti")
        return rows

    def draw(phase: int, stratum: str, rows: DataFrame, order: list[Column], quota: int) -> None:
        told = _first(left(rows), order, quota).select(
            F.lit(phase).alias("phase"), F.lit("").alias("skill"), "rank", F.lit(stratum).alias("stratum"),
            "session_id",
        )
        drawn.append(keep(told, "drawn"))

    metrics = (
        ("cost", "cost_usd", cost_quota), ("tool-errors", "tool_errors", error_quota),
        ("compactions", "compactions", compaction_quota),
    )
    for phase, (stratum, metric, quota) in enumerate(metrics, start=1):
        draw(phase, stratum, pool.filter(F.col(metric) > 0), [F.col(metric).desc(), F.col("session_id")], quota)
    wanted = best_of_each(
        left(users.join(major.select("skill"), "skill", "left_semi")), "skill",
        [F.col("started_at").desc_nulls_first(), F.col("session_id")], skills,
    )
    drawn.append(
        matched(keep(wanted, "wanted")).select(
            F.lit(4).alias("phase"), "skill", F.lit(1).alias("rank"),
            F.concat(F.lit("skill:"), "skill").alias("stratum"), "session_id",
        )
    )
    draw(
        5, "discovery", pool.filter(F.col("api_calls") >= min_discovery_api_calls),
        [drawn_by(F.col("session_id"), seed), F.col("session_id")], total - sum(d.count() for d in drawn),
    )
    # A row for each place of the budget at most.
    chosen = reduce(DataFrame.unionByName, drawn)
    n = F.row_number().over(Window.orderBy("phase", "skill", "rank")) - 1
    return chosen.withColumn("n", n).join(pool, "session_id").select(
        "n", "stratum", "session_id", "started_at", "turns", "agent_runs", "tool_calls",
        "tool_errors", "compactions", money(F.col("cost_usd")).alias("cost_usd"),
        "unpriced_api_calls",
    )


def best_of_each(rows: DataFrame, key: str, order: list[Column], most: int, ways: int = 64) -> DataFrame:
    """The first `most` rows of each key with their rank. A key's rows are ranked in parts first, and
    only the best of each part go on, so no key is in one task whole."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(ways))
    local = Window.partitionBy(key, "_part").orderBy(*order)
    best = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(local)).filter(F.col("rank") <= most)
    across = Window.partitionBy(key).orderBy(*order)
    return best.drop("_part").withColumn("rank", F.row_number().over(across)).filter(F.col("rank") <= most)


def matched(wanted: DataFrame) -> DataFrame:
    """(skill, rank, session_id): each skill with a session of its own, as if skills chose in order of
    their names, each the best of its list that is left. `wanted` holds the lists, rank from 1.

    All choose at once; of several that chose one session the first by name holds it, the others go on
    to the next of their lists, also a skill that loses what it held. It ends when nobody loses: after as
    many rounds as the longest run of such losses."""
    held = keep(wanted.filter("rank = 1").select("skill", "rank", "session_id"), "matched")
    while True:
        first = held.groupBy("session_id").agg(F.min("skill").alias("skill"))
        lost = keep(held.join(first, ["session_id", "skill"], "left_anti").select("skill", "rank"), "lost")
        if lost.isEmpty():
            return held
        again = lost.select("skill", (F.col("rank") + 1).alias("rank")).join(wanted, ["skill", "rank"])
        stay = held.join(lost.select("skill"), "skill", "left_anti")
        held = keep(stay.unionByName(again.select("skill", "rank", "session_id")), "matched")


def select_runs(
    t: Tables, scope: Scope, runs_per_stratum: int = 1, min_runs: int = 5
) -> DataFrame:
    """Per commonly used agent type: its runs with most errors, then its costliest others."""
    held = project_sessions(t, scope).filter("in_window").select("session_id")
    runs = keep(
        runs_with_spend(t)
        .join(held, "session_id", "left_semi")
        .withColumnRenamed("id", "agent_id"),
        "window_runs",
    )
    major = runs.groupBy("agent_type").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_runs
    )
    common = runs.join(major.select("agent_type"), "agent_type", "left_semi")

    def top(rows: DataFrame, metric: str, stratum: str) -> DataFrame:
        order = Window.partitionBy("agent_type").orderBy(
            F.col(metric).desc(), "session_id", "agent_id"
        )
        return (
            rows.filter(F.col(metric) > 0)
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= runs_per_stratum)
            .withColumn("stratum", F.lit(stratum))
        )

    erred = top(common, "tool_errors", "run-errors")
    others = common.join(
        erred.select("session_id", "agent_id"), ["session_id", "agent_id"], "left_anti"
    )
    return erred.unionByName(top(others, "cost_usd", "run-cost")).select(
        "stratum", "agent_type", "session_id", "agent_id", "started_at", "tool_calls",
        "tool_errors", "api_calls", money(F.col("cost_usd")).alias("cost_usd"),
        "unpriced_api_calls",
    )


def described_items(t: Tables, level: str) -> DataFrame:
    """Every described item of one level with what it cost to run."""
    said = (
        "category", "description", "outcome", "friction", "prompt_version", "enriched_at",
    )
    none = F.lit(None).cast("string")

    def spent(*keys: str) -> DataFrame:
        return t.corpus("api_calls").groupBy(*keys).agg(
            F.count(F.lit(1)).alias("api_calls"),
            F.sum("cost_usd").alias("cost_usd"),
            F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
        )

    if level == "turn":
        keys = ["session_id", "source", "turn_id"]
        rows = (
            t.corpus("turns").filter(F.col("source") == MAIN)
            .select("session_id", "source", F.col("id").alias("turn_id"))
            .join(t["turn_enrichments"], keys)
            .join(spent(*keys), keys, "left")
            .withColumns({"item_id": F.col("turn_id"), "agent_type": none})
            .withColumn("item_key", F.concat_ws("|", *keys))
        )
    elif level == "agent_run":
        rows = (
            t.corpus("agent_runs")
            .select("session_id", F.col("id").alias("agent_run_id"), "agent_type")
            .join(t["agent_run_enrichments"], ["session_id", "agent_run_id"])
            .withColumn("source", F.col("agent_run_id"))
            .join(spent("session_id", "source"), ["session_id", "source"], "left")
            .withColumn("item_id", F.col("agent_run_id"))
            .withColumn("item_key", F.concat_ws("|", "session_id", "agent_run_id"))
        )
    elif level == "session":
        rows = (
            t.rollups("corpus")
            .select("session_id", "api_calls", "cost_usd", "unpriced_api_calls")
            .join(t["session_enrichments"], "session_id")
            .withColumns({"source": none, "item_id": none, "agent_type": none})
            .withColumn("item_key", F.col("session_id"))
        )
    else:
        raise ValueError(f"no such level: {level}")
    return rows.select(
        "session_id", "source", "item_id", "item_key", "agent_type", *said,
        F.col("model").alias("enrichment_model"),
        F.coalesce("api_calls", F.lit(0)).alias("api_calls"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("unpriced_api_calls", F.lit(0)).alias("unpriced_api_calls"),
    )


def select_enrichments(
    t: Tables, scope: Scope, level: str, per_category: int = 2, seed: str = DRAW_SEED
) -> DataFrame:
    """A seeded draw of described items, so many from each category."""
    held = project_sessions(t, scope).select("session_id")
    draw = Window.partitionBy("category").orderBy(drawn_by(F.col("item_key"), seed), "item_key")
    return (
        described_items(t, level)
        .join(held, "session_id", "left_semi")
        .withColumn("draw", F.row_number().over(draw))
        .filter(F.col("draw") <= per_category)
        .select(
            F.col("category").alias("stratum"), "session_id", "source", "item_id", "agent_type",
            "api_calls", money(F.col("cost_usd")).alias("cost_usd"), "unpriced_api_calls",
            "description", "outcome", "friction", "enrichment_model", "prompt_version",
            "enriched_at", "draw",
        )
    )


def enrichment_coverage(t: Tables, scope: Scope) -> DataFrame:
    """How much of each level is described, under which stamp, with what was said."""
    said = [
        "category", "outcome", "friction", "model", "prompt_version", "taxonomy_version",
        "enriched_at",
    ]
    turns = (
        t.corpus("turns").filter(F.col("source") == MAIN)
        .select("session_id", "source", F.col("id").alias("turn_id"))
        .join(t["turn_enrichments"], ["session_id", "source", "turn_id"], "left")
        .select("session_id", F.lit("turn").alias("level"), *said)
    )
    runs = (
        t.corpus("agent_runs").select("session_id", F.col("id").alias("agent_run_id"))
        .join(t["agent_run_enrichments"], ["session_id", "agent_run_id"], "left")
        .select("session_id", F.lit("agent_run").alias("level"), *said)
    )
    worked = ((F.col("turns") > 0) | (F.col("agent_runs") > 0)) & (F.col("api_calls") > 0)
    whole = (
        t.rollups("corpus").filter(worked).select("session_id")
        .join(t["session_enrichments"], "session_id", "left")
        .select("session_id", F.lit("session").alias("level"), *said)
    )
    keys = ["level", "category", "outcome", "model", "prompt_version", "taxonomy_version"]
    per_session = (
        turns.unionByName(runs).unionByName(whole)
        .groupBy("session_id", *keys)
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.count("friction").alias("with_friction"),
            F.max("enriched_at").alias("last_enriched_at"),
        )
    )
    grouped = by_period(t, scope, per_session).groupBy("period", *keys).agg(
        F.sum("items").alias("items"),
        F.sum("with_friction").alias("with_friction"),
        F.max("last_enriched_at").alias("last_enriched_at"),
    )
    level = F.sum("items").over(Window.partitionBy("period", "level"))
    return grouped.select(
        "period", "level", "category", "outcome", F.col("model").alias("enrichment_model"),
        "prompt_version", "taxonomy_version", "items", level.alias("level_items"),
        F.round(F.lit(100.0) * F.col("items") / level, 1).alias("share_pct"),
        "with_friction", "last_enriched_at",
    )
