from __future__ import annotations

import random

from pyspark.sql import functions as F

from sessionlake.operators.select import best_of_each, matched


def test_skills_match_as_if_they_chose_in_turn(spark):
    rng = random.Random(6)
    for sessions, skills in ((12, 15), (40, 20), (3, 8)):
        lists = {f"k{k:02d}": rng.sample([f"s{s}" for s in range(sessions)], rng.randint(1, sessions)) for k in range(skills)}
        want, taken = {}, set()
        for skill in sorted(lists):
            free = next((s for s in lists[skill] if s not in taken), None)
            if free:
                want[skill] = free
                taken.add(free)
        rows = [(k, n, s) for k, held in lists.items() for n, s in enumerate(held, start=1)]
        got = matched(spark.createDataFrame(rows, "skill string, rank int, session_id string"))
        assert {r.skill: r.session_id for r in got.collect()} == want


def test_the_best_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(("hot" if k % 3 else f"c{k % 7}"), rng.randint(0, 400), f"s{k}") for k in range(3_000)]
    df = spark.createDataFrame(rows, "skill string, at int, session_id string").repartition(5)
    got = best_of_each(df, "skill", [F.col("at").desc(), F.col("session_id")], 9, ways=4)
    by = {}
    for skill, at, session in rows:
        by.setdefault(skill, []).append((-at, session))
    want = {(k, n, s) for k, held in by.items() for n, (_, s) in enumerate(sorted(held)[:9], start=1)}
    assert {(r.skill, r["rank"], r.session_id) for r in got.collect()} == want
