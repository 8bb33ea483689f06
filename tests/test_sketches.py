from __future__ import annotations

import random

from pyspark.sql import functions as F

from sessionlake.operators import sketches
from sessionlake.operators.relations import Scope, Tables

SCOPE = Scope(project="/p", as_of="2024-01-20", window_days=14)


def made(spark, rows):
    shape = (
        "session_id string, project_dir string, started_at timestamp, cost_usd double, input_tokens long, "
        "output_tokens long, cache_read_tokens long, cache_creation_tokens long, unpriced_api_calls long"
    )
    held = spark.createDataFrame([(*r, 1, 2, 3, 4, 0) for r in rows], "session_id string, project_dir string, "
                                 "started_at string, cost_usd double, a int, b int, c int, d int, e int")
    held = held.toDF("session_id", "project_dir", "started_at", "cost_usd", "input_tokens", "output_tokens",
                     "cache_read_tokens", "cache_creation_tokens", "unpriced_api_calls")
    held = held.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in shape.split(", ")])
    return Tables({"session_rollups": held.withColumn("family", F.lit("corpus"))})


def test_percentiles_stay_within_the_stated_error(spark):
    rng = random.Random(2)
    rows = [
        (f"s{k}", rng.choice(["/p", "/p/a", "/q", None]), rng.choice([f"2024-01-{1 + k % 28:02d} 10:00:00", None]),
         float(int(rng.paretovariate(1.1) * 100)) / 16)
        for k in range(20_000)
    ]
    t = made(spark, rows)
    for k in (64, 800):
        told = {r.period: r for r in sketches.sketched_cost_distribution(sketches.cost_sketches(t, k), SCOPE, k).collect()}
        under = [r for r in rows if r[1] in ("/p", "/p/a")]
        recent = [r for r in under if r[2] and "2024-01-06" < r[2] < "2024-01-21"]
        assert told["corpus"].sessions == len(under)
        assert abs(told["trailing_window"].sessions - len(recent)) <= len(recent) / 10
        costs = sorted(r[3] for r in under)
        assert told["corpus"].max_cost_usd == round(costs[-1], 4)
        for name, q in sketches.QUANTILES.items():
            value, room = told["corpus"][name], sketches.rank_error(k) * len(costs) + 1
            below, upto = sum(c < value for c in costs), sum(c <= value for c in costs)
            assert below - room <= q * len(costs) <= upto + room, (k, name)


def test_some_days_made_anew_are_those_of_all(spark):
    rows = [(f"s{k}", None if k % 5 == 0 else "/p", None if k % 7 == 0 else f"2024-01-{1 + k % 9:02d} 01:00:00", k / 8) for k in range(300)]
    t = made(spark, rows)
    held = sketches.cost_sketches(made(spark, [(s, p, d, c * 2 if d and "01-03" in d else c) for s, p, d, c in rows]))
    new = sketches.cost_sketches(made(spark, [r for r in rows if r[2] and "01-03" in r[2]]))
    got = {tuple(r) for r in sketches.replaced(held, new).drop("costs").collect()}
    assert got == {tuple(r) for r in sketches.cost_sketches(t).drop("costs").collect()}
    assert sketches.sketched_cost_distribution(held.limit(0), SCOPE).collect() == []
