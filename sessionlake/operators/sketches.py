"""Spend by mergeable sketches: for corpora whose sessions are too many to rank on every question.

`cost_sketches` holds, per project folder and day of start, counts and sums and a quantile sketch of the
sessions' costs: one row for any number of sessions. Sketches of the folders and days that a question
covers are merged when it is asked, so the answer costs what the folders and days are, not the sessions.
Counts, sums and the largest are exact; a percentile is the cost of a session whose rank is off
by `rank_error(k)` of all sessions at most, in 99 of 100 answers. `cost_distribution` stays the exact way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.text import under_path
from sessionlake.functions.times import within_days
from sessionlake.operators.relations import Scope, Tables, by_period, periods

#: Values a sketch keeps at its finest level.
K = 800
KEY = ["project_dir", "day"]
QUANTILES = {"p50_cost_usd": 0.5, "p90_cost_usd": 0.9, "p99_cost_usd": 0.99}


def rank_error(k: int = K) -> float:
    """The published bound of this sketch: share of all values that a rank may be off by, 99 in 100."""
    return 2.446 / k**0.9021


def cost_sketches(t: Tables, k: int = K) -> DataFrame:
    """One row per project folder and day: what `cost_distribution` needs of its sessions."""
    tokens = sum(
        (F.col(c) for c in ("output_tokens", "cache_read_tokens", "cache_creation_tokens")), F.col("input_tokens")
    )
    return (
        t.rollups("corpus").withColumn("day", F.to_date("started_at")).groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("sessions"), F.sum("cost_usd").alias("cost_usd"),
            F.max("cost_usd").alias("max_cost_usd"), F.sum(tokens).alias("tokens"),
            F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
            F.kll_sketch_agg_double("cost_usd", k).alias("costs"),
        )
    )


def replaced(held: DataFrame, new: DataFrame) -> DataFrame:
    """Stored sketches with those of some folders and days made anew."""
    same = [held[c].eqNullSafe(new[c]) for c in KEY]
    return held.join(new, same, "left_anti").unionByName(new)


def sketched_cost_distribution(sketches: DataFrame, scope: Scope, k: int = K) -> DataFrame:
    """`cost_distribution` off stored sketches, without the costliest tenth's share."""
    rows = sketches.filter(under_path(F.col("project_dir"), scope.project))
    if scope.since is not None:
        rows = rows.filter(F.col("day") >= F.to_date(F.lit(scope.since)))
    recent = within_days(F.col("day").cast("timestamp"), scope.as_of, scope.window_days)
    merged = rows.withColumn("in_window", recent).select(periods(), *sketches.columns).groupBy("period").agg(
        *[F.sum(c).alias(c) for c in ("sessions", "cost_usd", "tokens", "unpriced_api_calls")],
        F.max("max_cost_usd").alias("max_cost_usd"), F.kll_merge_agg_double("costs", k).alias("costs"),
    )
    return merged.select(
        "period", "sessions", F.round("cost_usd", 4).alias("cost_usd"),
        F.round(F.col("cost_usd") / F.col("sessions"), 4).alias("mean_cost_usd"),
        *[F.kll_sketch_get_quantile_double("costs", F.lit(q)).alias(n) for n, q in QUANTILES.items()],
        F.round("max_cost_usd", 4).alias("max_cost_usd"), "tokens", "unpriced_api_calls",
    )


def ranks_held(t: Tables, scope: Scope, k: int = K) -> DataFrame:
    """The sketched answer with, for each percentile, whether its rank among all sessions is within the
    stated error: a check of the sketches against the sessions themselves."""
    told = sketched_cost_distribution(cost_sketches(t, k), scope, k)
    costs = by_period(t, scope, t.rollups("corpus").select("session_id", "cost_usd")).select(
        "period", F.col("cost_usd").alias("_cost")
    )
    counted = costs.join(F.broadcast(told.select("period", *QUANTILES)), "period").groupBy("period").agg(
        *[F.count_if(F.col("_cost") < F.col(n)).alias(f"_below_{n}") for n in QUANTILES],
        *[F.count_if(F.col("_cost") <= F.col(n)).alias(f"_upto_{n}") for n in QUANTILES],
    )
    room = F.lit(rank_error(k)) * F.col("sessions") + 1

    def within(name: str, q: float):
        place = F.lit(q) * F.col("sessions")
        return ((F.col(f"_below_{name}") - room <= place) & (place <= F.col(f"_upto_{name}") + room)).alias(f"{name}_held")

    return told.join(counted, "period").select(
        "period", "sessions", "cost_usd", "mean_cost_usd", "max_cost_usd", "tokens", "unpriced_api_calls",
        *[within(n, q) for n, q in QUANTILES.items()],
    )
