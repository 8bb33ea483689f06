"""Copies and counts kept up write by write, against finding them anew."""

from __future__ import annotations

import random
from collections import Counter

from sessionlake import schema
from sessionlake.operators import corpus
from sessionlake.operators.relations import Scope, Tables
from sessionlake.sources.store import Store
from sessionlake.sources.upkeep import COUNTS


def told(df):
    names = sorted(df.columns)
    return Counter(tuple(str(r[n]) for n in names) for r in df.collect())


def test_kept_up_is_found_anew_after_any_writes(spark, telemetry, tmp_path):
    rng = random.Random(8)
    store = Store(spark, str(tmp_path / "store"), buckets=4, kept_up=True)
    every = sorted(r.id for r in telemetry["sessions"].select("id").collect())
    # Sessions that repeat each other's ids, so that owners come and go.
    shared = sorted({r.session_id for r in telemetry.copies("api_calls").collect()})[:6]
    near = [s for s in every if s.split("-")[0] in {x.split("-")[0] for x in shared}][:14]
    some = [*near, *[s for s in every if s not in near][:6]]
    frames = {n: telemetry[n] for n in COUNTS}

    def write(there, gone=()):
        ids = spark.createDataFrame([(s,) for s in [*there, *gone]], "session_id string")
        kept = list(there)
        store.replace(
            {n: rows.filter(rows[schema.session_column(n)].isin(kept)) for n, rows in frames.items()}, ids
        )

    def compare():
        plain = Tables({n: store.table(n) for n in COUNTS})
        kept = store.tables()
        for name in ("api_calls", "turns"):
            assert told(kept.copies(name)) == told(plain.copies(name)), name
        for family in ("live", "corpus"):
            assert told(kept.rollups(family)) == told(plain.rollups(family)), family
        assert told(kept.corpus("tool_calls")) == told(plain.corpus("tool_calls"))

    write(some[::2])
    compare()
    assert store.tables()["copied_ids"].count() >= 0
    write(some[1::2])
    assert store.tables()["copied_ids"].count() > 0
    compare()
    gone = rng.sample(some, 6)
    write(rng.sample([s for s in some if s not in gone], 4), gone)
    compare()
    write(gone[:3])
    compare()
    report = corpus.session_counts(store.tables(), Scope(project="/p", as_of="2024-01-20", window_days=14))
    assert report.count() > 0
