"""Folds over slices give what one fold over the whole thread gives, a third of the rows in one."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from sessionlake.operators.tree import ancestors
from sessionlake.operators.windows import block_of, distinct_ranks, previous, running


def _threads(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for key, size in (("hot", 200), ("a", 90), ("b", 1), ("c", 60)):
        for i in range(size):
            value = rng.choice([None, rng.randint(0, 99)])
            rows.append((key, "main", i * 2, value, rng.random() < 0.3))
    return rows


def test_running_matches_a_plain_loop(spark):
    rows = _threads()
    df = spark.createDataFrame(rows, "session_id string, source string, pos int, v int, flag boolean")
    out = running(
        df, ["session_id", "source"], block_of(F.col("pos"), 16), ["pos"],
        counts={"n": F.col("flag")}, lasts={"held": F.col("v")}, maxes={"top": F.col("v")},
        sums={"total": F.coalesce("v", F.lit(0))},
    )
    got = {(r.session_id, r.pos): (r.n, r.held, r.top, r.total) for r in out.collect()}
    state: dict[str, list] = {}
    for key, _, pos, v, flag in rows:
        n, held, top, total = state.get(key, [0, None, None, 0])
        if v is not None:
            held, top = v, v if top is None else max(top, v)
        assert got[key, pos] == (n, held, top, total)
        state[key] = [n + flag, held, top, total + (v or 0)]


def test_previous_is_lag_and_keeps_nulls(spark):
    rows = _threads(3)
    df = spark.createDataFrame(rows, "session_id string, source string, pos int, v int, flag boolean")
    got = {(r.session_id, r.pos): (r.before, r.at) for r in
           previous(df, "pos", {"before": F.col("v"), "at": F.col("pos")}).collect()}
    last: dict[str, tuple] = {}
    for key, _, pos, v, _flag in rows:
        assert got[key, pos] == last.get(key, (None, None))
        last[key] = (v, pos)


def test_ranks_are_exact_with_a_hot_value(spark):
    rng = random.Random(1)
    values = [0.0] * 400 + [round(rng.random() * 50, 2) for _ in range(800)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = {r.v: (r.n, r.below, r.total) for r in distinct_ranks(df, ["g"], "v", splits=16).collect()}
    array = np.array(values)
    assert got == {
        v: (int((array == v).sum()), int((array < v).sum()), len(values)) for v in set(values)
    }


def test_ancestors_climb_deep_and_stop_at_cycles(spark):
    edges = [("s", f"n{i}", f"n{i + 1}") for i in range(20)] + [("s", "x", "y"), ("s", "y", "x")]
    df = spark.createDataFrame(edges, "session_id string, node string, above string")
    got = {(r.node, r.above) for r in ancestors(df, ["session_id"], "node", "above").collect()}
    chain = {(f"n{i}", f"n{j}") for i in range(20) for j in range(i + 1, 21)}
    assert got == chain | {("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}


def test_blocks_cover_an_interval_once(spark):
    import random

    from pyspark.sql import functions as F

    from sessionlake.operators.windows import blocks_holding, covering

    rng = random.Random(1)
    ends = [(0, 0), (1, 1), (-3, 5), (-9, -9), (7, 6), (0, 63), (5, 473_000), (None, 3), (3, None)]
    ends += [(a, a + rng.randint(0, 70)) for a in (rng.randint(-50, 50) for _ in range(60))]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(ends)], "k int, a long, b long")
    cover = rows.select("k", F.inline(covering(F.col("a"), F.col("b"))))
    points = spark.range(-80, 130).select(F.col("id"), F.inline(blocks_holding(F.col("id"))))
    met = cover.join(points, ["level", "block"]).select("k", "id").collect()
    assert len(met) == len(set(map(tuple, met)))
    assert set(map(tuple, met)) == {
        (k, n) for k, (a, b) in enumerate(ends) if a is not None and b is not None for n in range(-80, 130) if a <= n <= b
    }
    assert cover.groupBy("k").count().agg(F.max("count")).first()[0] <= 40


def test_closures_write_each_round_once_and_broadcast_none(spark, monkeypatch):
    from sessionlake.operators import tree

    plans = []

    def watched(df, label, _keep=tree.keep):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return _keep(df, label)

    monkeypatch.setattr(tree, "keep", watched)
    df = spark.createDataFrame([("s", k, k + 1) for k in range(9)], "session_id string, node long, above long")
    assert tree.ancestors(df, ["session_id"], "node", "above").count() == 45
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
