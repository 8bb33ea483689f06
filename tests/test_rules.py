"""Invariants of the relations, the report registry, SQL functions and the streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import pricing, text
from sessionlake.operators import corpus, gaps
from sessionlake.operators.relations import Scope
from sessionlake.plans import registry
from sessionlake.plans.sql import install_functions, install_views
from sessionlake.schema import COUNTED
from sessionlake.streaming.refresh import call_sessions, call_windows

SCOPE = Scope(project="/p", as_of="2024-01-20", window_days=14)


def test_corpus_lies_in_live_lies_in_base(telemetry):
    for name in COUNTED:
        base, live, own = telemetry[name], telemetry.live(name), telemetry.corpus(name)
        assert own.join(live, ["session_id", "id"], "left_anti").count() == 0
        assert own.count() <= live.count() <= base.count()
        holders = own.groupBy("id").agg(F.count_distinct("session_id").alias("n"))
        assert holders.filter("n > 1").count() == 0


def test_window_is_part_of_the_corpus_and_weeks_are_all_of_it(telemetry):
    rows = {r.period: r for r in corpus.session_counts(telemetry, SCOPE).collect()}
    assert rows["trailing_window"].sessions < rows["corpus"].sessions
    weeks = corpus.weekly_trend(telemetry, SCOPE).agg(F.sum("sessions")).first()[0]
    assert weeks == rows["corpus"].sessions
    shapes = corpus.session_shapes(telemetry, SCOPE).filter("period = 'corpus'")
    assert shapes.agg(F.sum("sessions")).first()[0] == rows["corpus"].sessions


def test_threads_sum_to_the_total(telemetry):
    rows = gaps.context_reloads(telemetry, SCOPE, idle_seconds=20_000).filter("period = 'corpus'")
    by_grain = {r.grain: r.n for r in rows.groupBy("grain").agg(F.sum("reloads").alias("n")).collect()}
    assert len(set(by_grain.values())) == 1 and by_grain.keys() == {"corpus", "agent_type", "thread"}


def test_registry_refuses_what_it_does_not_know(telemetry):
    with pytest.raises(TypeError):
        registry.run("reload_cost_split", telemetry, SCOPE)
    with pytest.raises(TypeError):
        registry.run("tool_failures", telemetry, SCOPE, nonsense=1)
    with pytest.raises(KeyError):
        registry.run("nothing", telemetry, SCOPE)
    asked = registry.run("error_signatures", telemetry, SCOPE, min_occurrences=1)
    assert "min_occurrences=1" in asked.citation and "as_of=2024-01-20" in asked.citation
    names = {p.name for p in registry.parameters("context_reloads")}
    assert names == {"min_rebuilt_tokens", "min_rebuilt_pct", "idle_seconds"}


def test_sql_functions_follow_the_columns(spark, telemetry):
    install_functions(spark)
    install_views(telemetry)
    row = spark.sql(
        "SELECT signature_line('a  /x/y.py, b\\nc') AS s, context_window('claude-opus-5') AS w, "
        "context_window('nobody') AS n, cut_text('abcdef', 3) AS c, "
        "tool_asked('{\"command\":\"ls\"}', 'command', 9) AS t, tool_asked('{', 'command', 9) AS bad"
    ).first()
    assert tuple(row) == ("a <path>, b", 200_000, None, "abcd", "ls", None)
    assert spark.sql("SELECT count(*) FROM corpus_turns").first()[0] == telemetry.corpus("turns").count()


def test_text_rules(spark):
    row = spark.range(1).select(
        text.invocation(F.lit("A=1 cd /x && /usr/bin/git status -s")).alias("line"),
        text.path_tail(F.lit("/a/b/c"), 2).alias("tail"),
        text.path_tail(F.lit("b"), 3).alias("short"),
        text.worktree_base(F.lit("/r/.claude/worktrees/x/src")).alias("base"),
        text.worktree_base(F.lit("/r/plain")).alias("plain"),
        pricing.meter(F.lit(1.0)).alias("full"), pricing.meter(F.lit(0.0)).alias("none"),
        pricing.meter(F.lit(0.0001)).alias("low"),
    ).first()
    assert tuple(row) == ("git status -s", "b/c", "b", "/r", "/r/plain", "s10", "s0", "s1")


def test_streamed_windows_and_bursts_run(spark, telemetry, tmp_path):
    calls = telemetry.live("api_calls").select("session_id", "source", "started_at", "cost_usd")
    folder = str(tmp_path / "calls")
    calls.write.parquet(folder)
    for n, shape in enumerate((call_windows, call_sessions)):
        stream = spark.readStream.schema(calls.schema).parquet(folder)
        query = (
            shape(stream).writeStream.format("memory").queryName(f"seen_{n}")
            .trigger(availableNow=True).outputMode("append").start()
        )
        query.awaitTermination(120)
        assert spark.table(f"seen_{n}").count() > 0


def test_spans_are_sent_once(spark, telemetry, tmp_path, monkeypatch):
    from sessionlake.operators.relations import Tables
    from sessionlake.spans import delivery
    from sessionlake.spans.spans import spans

    shape = spans(telemetry).schema
    box = delivery.Outbox(spark, str(tmp_path / "sent"), "other")
    due = delivery.undelivered(telemetry, "other").count()
    told = delivery.census(telemetry, "other").first()
    create = delivery.create

    # A driver that dies with everything written but nothing committed has sent nothing.
    def dies(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(delivery, "create", dies)
    with pytest.raises(KeyboardInterrupt):
        box.send(telemetry)
    assert box.spans(shape).count() == 0 and box.ledger().count() == 0

    # A send that is overtaken by another of the same sessions starts over and finds nothing to do.
    met = []

    def overtaken(*args):
        if not met:
            met.append(1)
            monkeypatch.setattr(delivery, "create", create)
            met.append(delivery.Outbox(spark, str(tmp_path / "sent"), "other").send(telemetry))
        return create(*args)

    monkeypatch.setattr(delivery, "create", overtaken)
    assert box.send(telemetry) is None
    rows = met[1].collect()
    assert told.sessions == len(rows) and told.spans == sum(r.spans_sent for r in rows)
    sent = box.spans(shape)
    assert sent.count() == told.spans == sent.select("session_id", "span_id").distinct().count()
    # A driver that dies right after the commit is done: the next one asks the same ledger.
    assert box.send(telemetry) is None
    after = Tables({**telemetry.frames, "span_delivery": box.ledger().select(telemetry["span_delivery"].columns)})
    assert delivery.undelivered(after, "other").count() == due - len(rows)

    # A session whose files changed is sent again, the others are not.
    one = rows[0].session_id
    state = telemetry["extract_state"].withColumn(
        "fingerprint", F.when(F.col("session_id") == one, "changed").otherwise(F.col("fingerprint"))
    )
    again = box.send(Tables({**telemetry.frames, "extract_state": state}))
    assert [r.session_id for r in again.collect()] == [one]
    assert {r.fingerprint for r in box.ledger().filter(F.col("session_id") == one).collect()} == {"changed"}


def test_no_calls_to_look_at_means_no_listing(telemetry):
    scope = Scope(project="/p", as_of="2024-01-20", window_days=14)
    rows = gaps.missing_file_recovery(telemetry, scope, within_calls=0).collect()
    told = {(r.period, r.recovery): r.failures for r in rows}
    most = {(r.period, r.recovery): r.failures for r in gaps.missing_file_recovery(telemetry, scope, within_calls=3).collect()}
    for period in {p for p, _ in told}:
        assert told[period, "no listing"] == sum(n for (p, _), n in most.items() if p == period)
        assert told[period, "listed elsewhere"] == told[period, "listed the directory"] == 0


def test_reloads_after_compactions_at_the_bounds(spark):
    from sessionlake.operators.gaps import _after_compaction

    spans = [(1, 100.0, 200.0), (2, 200.0, 200.0), (3, 86_000.0, 87_000.0), (4, 90_000.0, 400_000.0), (5, 5.0, None)]
    pressed = [100.5, 101.0, 201.0, 201.5, 86_500.0, 90_000.0, 399_999.0]
    def at(column):
        return F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col(column) * 1_000_000).cast("long"))
    calls = spark.createDataFrame([("s", "main", *r) for r in spans], "session_id string, source string, n int, a double, b double")
    calls = calls.select("session_id", "source", at("a").alias("previous_start"), at("b").alias("started_at"))
    held = spark.createDataFrame([("s", "main", p) for p in pressed] + [("s", "r", 150.0)], "session_id string, source string, p double")
    got = _after_compaction(calls, held.select("session_id", "source", at("p").alias("timestamp")))
    want = sorted(a for _, a, b in spans if b is not None and any(a + 1 < p <= b + 1 for p in pressed))
    assert sorted(r.since.second + r.since.minute * 60 + r.since.hour * 3600 + (r.since.day - 1) * 86_400 - 1
                  for r in got.collect()) == want
