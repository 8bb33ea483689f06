"""Lists a reader starts from: projects, sessions, described sessions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlake.functions.text import cut, under_path
from sessionlake.functions.times import within_days
from sessionlake.operators.corpus import money
from sessionlake.operators.relations import WINDOW_DAYS, Tables, folded_projects

HEAD_CHARS = 100
ITEM_CHARS = 40
HEAD_ITEMS = 3


def _rooted(t: Tables) -> DataFrame:
    rollups = t.rollups("corpus")
    return rollups.join(folded_projects(t["sessions"]), "project_dir", "left")


def project_rollups(
    t: Tables,
    as_of: str,
    recent_days: int = 7,
    window_days: int = WINDOW_DAYS,
    head_chars: int = HEAD_CHARS,
    projects: int = 50,
) -> DataFrame:
    """The projects worth opening: counts and spend of the last days, the window and all time.

    `matched_rows` counts the projects there are, taken before the list is cut to its first page.
    """
    recent = within_days(F.col("started_at"), as_of, recent_days)
    inside = within_days(F.col("started_at"), as_of, window_days)

    def only(flag: Column, column: str) -> Column:
        return F.sum(F.when(flag, F.col(column)))

    grouped = _rooted(t).groupBy("root").agg(
        F.count_if(recent).alias("recent_sessions"),
        money(only(recent, "cost_usd")).alias("recent_cost"),
        only(recent, "unpriced_api_calls").alias("recent_unpriced"),
        F.count_if(inside).alias("window_sessions"),
        money(only(inside, "cost_usd")).alias("window_cost"),
        only(inside, "unpriced_api_calls").alias("window_unpriced"),
        F.count(F.lit(1)).alias("sessions"),
        money(F.sum("cost_usd")).alias("cost_usd"),
        F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
        F.max("started_at").alias("last_active"),
    )
    page = grouped.orderBy(F.col("last_active").desc_nulls_last(), "root").limit(projects)
    matched = grouped.agg(F.count(F.lit(1))).scalar()
    root = F.col("root")
    return page.select(
        cut(root, head_chars).alias("project_dir"),
        F.when(F.length(root) <= head_chars, root).alias("project_filter"),
        *[c for c in grouped.columns if c != "root"],
        matched.alias("matched_rows"),
    )


def busiest_projects(t: Tables, head_chars: int = HEAD_CHARS, head_projects: int = 10) -> DataFrame:
    return (
        _rooted(t)
        .filter(F.col("root").isNotNull() & (F.length("root") <= head_chars))
        .groupBy(F.col("root").alias("project_dir"))
        .agg(F.count(F.lit(1)).alias("sessions"))
        .orderBy(F.col("sessions").desc(), "project_dir")
        .limit(head_projects)
    )


def first_names(
    rows: DataFrame, keys: list[str], column: str, alias: str, items: int, chars: int | None = None
) -> DataFrame:
    """The first `items` distinct values per key in order, and how many more there are.

    Ranked before it is gathered, so a key with any number of values gathers only the few shown.
    """
    names = rows.select(*keys, column).filter(F.col(column).isNotNull()).distinct()
    ranked = names.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(column))
    ).filter(F.col("_n") <= items)
    total = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    held = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(column)).alias("_held"))
    if chars is not None:
        shown = F.transform("_held", lambda v: cut(v, chars))
    else:
        shown = F.col("_held")
    return held.join(total, keys).select(
        *keys, shown.alias(alias),
        F.greatest(F.col("_total") - items, F.lit(0)).cast("int").alias(f"{alias}_cut"),
    )


def _kinds(
    rows: DataFrame, name: Column, counted: str, items: int, alias: str
) -> DataFrame:
    """The most frequent kinds per session as (name, count), and how many more kinds there are."""
    counts = rows.groupBy("session_id", name.alias("name")).agg(
        F.count(F.lit(1)).alias(counted)
    )
    by_rank = Window.partitionBy("session_id").orderBy(F.col(counted).desc(), "name")
    ranked = counts.withColumn("_n", F.row_number().over(by_rank)).filter(F.col("_n") <= items)
    total = counts.groupBy("session_id").agg(F.count(F.lit(1)).alias("_total"))
    return (
        ranked.groupBy("session_id")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "name", counted))).alias("_held"))
        .join(total, "session_id")
        .select(
            "session_id",
            F.transform(
                "_held", lambda k: F.struct(k["name"].alias("name"), k[counted].alias(counted))
            ).alias(alias),
            F.greatest(F.col("_total") - items, F.lit(0)).cast("int").alias(f"{alias}_cut"),
        )
    )


def described_sessions(
    t: Tables, head_chars: int = HEAD_CHARS, tag_chars: int = 20, kind_chars: int = 20,
    head_kinds: int = HEAD_ITEMS,
) -> DataFrame:
    """What a description pass said of each session and of the work its turns did."""
    said = t["session_enrichments"]
    turns = t["turn_enrichments"]
    work = _kinds(turns, F.substring("category", 1, kind_chars), "turns", head_kinds, "work")
    named = said.select("session_id").union(turns.select("session_id")).distinct()
    empty = F.array().cast("array<struct<name:string,turns:bigint>>")
    return (
        named.join(said, "session_id", "left")
        .join(work, "session_id", "left")
        .select(
            "session_id",
            cut(F.col("description"), head_chars).alias("description"),
            F.substring("category", 1, tag_chars).alias("category"),
            F.substring("outcome", 1, tag_chars).alias("outcome"),
            F.coalesce("work", empty).alias("work"),
            F.coalesce("work_cut", F.lit(0)).alias("work_cut"),
        )
    )


# What the session list may be sorted and narrowed by.
SORTS = (
    "started_at", "title", "project_dir", "turns", "api_calls", "tool_calls", "compactions",
    "tool_errors", "cost_usd", "wall_ms", "agent_runs",
)
FILTERS = ("project", "since", "until", "skill", "errors")


def session_list(
    t: Tables,
    sort: str = "started_at",
    descending: bool = True,
    filters: Mapping[str, object] | None = None,
    limit: int = 50,
    offset: int = 0,
    described: bool = False,
    head_chars: int = HEAD_CHARS,
    item_chars: int = ITEM_CHARS,
    head_items: int = HEAD_ITEMS,
) -> DataFrame:
    """One page of sessions and one row more, sorted totally: the id breaks ties, unknowns go last.

    Sorting and filtering read narrow columns; lists of names are gathered for the page alone.
    """
    filters = dict(filters or {})
    if sort not in SORTS or not filters.keys() <= set(FILTERS):
        raise KeyError(f"unknown sort or filter: {sort}, {sorted(filters)}")
    errors = (
        t.live("tool_calls").filter("is_error").groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("tool_errors"))
    )
    rows = (
        t.rollups("live")
        .join(errors, "session_id", "left")
        .withColumn("tool_errors", F.coalesce("tool_errors", F.lit(0)))
        .withColumn("cost_usd", money(F.col("cost_usd")))
    )
    skills = t.live("api_calls").select("session_id", F.col("attribution_skill").alias("skills"))
    if "project" in filters:
        rows = rows.filter(under_path(F.col("project_dir"), str(filters["project"])))
    if "since" in filters:
        since = F.to_date(F.lit(str(filters["since"]))).cast("timestamp")
        rows = rows.filter(F.col("started_at") >= since)
    if "until" in filters:
        until = F.date_add(F.to_date(F.lit(str(filters["until"]))), 1).cast("timestamp")
        rows = rows.filter(F.col("started_at") < until)
    if "skill" in filters:
        users = skills.filter(F.col("skills") == str(filters["skill"]))
        rows = rows.join(users, "session_id", "left_semi")
    if "errors" in filters:
        rows = rows.filter(F.col("tool_errors") >= int(str(filters["errors"])))
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    tie = F.col("session_id").desc() if descending else F.col("session_id").asc()
    page = rows.orderBy(order, tie).limit(limit + 1 + offset).offset(offset)
    keys = page.select("session_id")
    names = first_names(
        skills.join(keys, "session_id", "left_semi"), ["session_id"], "skills", "skills",
        head_items, item_chars,
    )
    agents = _kinds(
        t.live("agent_runs").join(keys, "session_id", "left_semi"),
        cut(F.col("agent_type"), item_chars), "runs", head_items, "agent_types",
    )
    page = page.join(names, "session_id", "left").join(agents, "session_id", "left")
    if described:
        page = page.join(described_sessions(t), "session_id", "left")
    no_names = F.array().cast("array<string>")
    no_kinds = F.array().cast("array<struct<name:string,runs:bigint>>")
    return page.withColumns(
        {
            "title": cut(F.col("title"), head_chars),
            "project_dir": cut(F.col("project_dir"), head_chars),
            "skills": F.coalesce("skills", no_names),
            "skills_cut": F.coalesce("skills_cut", F.lit(0)),
            "agent_types": F.coalesce("agent_types", no_kinds),
            "agent_types_cut": F.coalesce("agent_types_cut", F.lit(0)),
        }
    )
