"""Recorded sessions on disk, through ingest into the archive and back."""

from __future__ import annotations

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from sessionlake.sources.discover import listing, numbered_lines, projects
from sessionlake.sources.store import Store, migrated, refresh
from sessionlake.operators.relations import Scope
from sessionlake.plans.registry import run


def record(kind: str, uuid: str | None, second: int, **members) -> str:
    base = {"type": kind, "timestamp": f"2024-03-01T10:00:{second:02d}.000Z", "cwd": "/p/a"}
    if uuid:
        base["uuid"] = uuid
    return json.dumps({**base, **members})


def user(uuid: str, second: int, content, **members) -> str:
    return record("user", uuid, second, message={"role": "user", "content": content}, **members)


def reply(uuid: str, second: int, message_id: str, blocks: list, parent: str | None = None) -> str:
    usage = {
        "input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 3,
        "cache_creation_input_tokens": 4,
    }
    message = {"id": message_id, "model": "claude-opus-5", "content": blocks, "usage": usage}
    return record("assistant", uuid, second, message=message, parentUuid=parent)


def write(path: pathlib.Path, lines: list[str], end: str = "\n") -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + end)


@pytest.fixture()
def recordings(tmp_path):
    root = tmp_path / "projects"
    tool = {"type": "tool_use", "id": "toolu_1", "name": "Agent", "input": {"prompt": "go", "b": [1, 2]}}
    answer = [{"type": "tool_result", "tool_use_id": "toolu_1", "content": [{"type": "text", "text": "done"}]}]
    main = [
        user("u1", 1, "hello there"),
        reply("a1", 2, "m1", [{"type": "text", "text": "hi"}], "u1"),
        reply("a2", 3, "m1", [tool], "a1"),
        user("u2", 4, answer, toolUseResult={"persistedOutputPath": "/x/out.txt"}),
        user("u3", 5, "<command-name>/go</command-name><command-args> fast </command-args>"),
        json.dumps({"type": "custom-title", "customTitle": "Named"}),
        record("mystery", "z1", 6, odd=1),
    ]
    write(root / "-p-a" / "s1.jsonl", main, end='\n{"type":"user","cut')
    run_dir = root / "-p-a" / "s1" / "subagents"
    write(run_dir / "agent-r1.jsonl", [
        user("u1", 1, "hello there"),
        user("r1", 7, "own task"),
        reply("b1", 8, "m2", [{"type": "text", "text": "ok"}], "r1"),
    ])
    (run_dir / "agent-r1.meta.json").write_text(
        json.dumps({"agentType": "fork", "toolUseId": "toolu_1", "spawnDepth": 1, "isFork": True})
    )
    out = root / "-p-a" / "s1" / "tool-results"
    out.mkdir(parents=True)
    (out / "out.txt").write_bytes(b"caf\xe9 text")
    write(root / "-p-a" / "s2.jsonl", [user("u1", 1, "broken"), "{not json", user("u2", 2, "later")])
    write(root / "-p-b" / "s3.jsonl", [user("d1", 1, "one"), user("d1", 2, "two")])
    write(root / "-p-b" / "s4.jsonl", [user("q1", 1, "<odd-tag> x")])
    write(root / "-p-b" / "s5.jsonl", [user("k1", 1, "fine")])
    (root / "-p-b" / "s6" / "subagents").mkdir(parents=True)
    write(root / "-p-b" / "s6.jsonl", [user("h1", 1, "fine")])
    write(root / "-p-b" / "s6" / "subagents" / "agent-x.jsonl", [user("h2", 1, "alone")])
    return root


def test_refresh_reads_rejects_and_skips(spark, recordings, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    done = refresh(store, str(recordings), tags={"batch": "b1"})
    status = {r.session_id: r.status for r in done.status.collect()}
    assert status == {"s1": "extracted", "s5": "extracted", "s2": "refused", "s3": "refused",
                      "s4": "refused", "s6": "refused"}
    rules = {(r.session_id, r.rule) for r in done.rejects.collect()}
    assert {("s2", "unparseable line"), ("s3", "uuid with two contents"),
            ("s4", "unknown leading tag"), ("s6", "transcript or description alone")} <= rules
    assert [r.name for r in done.kinds.collect()] == ["mystery"]
    assert done.fields.collect() == []

    t = store.tables()
    turns = {(r.source, r.id): r for r in t["turns"].filter("session_id = 's1'").collect()}
    assert turns["main", "u3"].command_args == "fast" and turns["main", "u1"]["index"] == 0
    assert turns["r1", "u1"].replayed and not turns["r1", "r1"].replayed
    assert turns["main", "u1"].prompt == "hello there"
    call = t["api_calls"].filter("id = 'm1'").first()
    assert (call.text, call.turn_id, call["index"]) == ("hi", "u1", 0)
    assert call.cost_usd == pytest.approx((1 * 5 + 2 * 25 + 3 * 0.5 + 4 * 6.25) / 1e6)
    tool = t["tool_calls"].first()
    assert (tool.result, tool.offload_file, json.loads(tool.input)) == (
        "done", "out.txt", {"prompt": "go", "b": [1, 2]})
    agent = t["agent_runs"].first()
    assert agent.is_fork and agent.started_at.second == 7
    session = t["sessions"].filter("id = 's1'").first()
    assert (session.title, session.project_dir) == ("Named", "/p/a")
    offload = t["offload_files"].first()
    assert offload.lossy_decode and offload.size_bytes == 9 and "caf" in offload.content
    assert t["raw_records"].filter("session_id = 's1' AND source = 'main'").count() == 7
    assert {r.session_id for r in t["session_tags"].collect()} == {"s1", "s5"}
    assert t.live("turns").filter("session_id = 's1'").count() == 3

    again = refresh(store, str(recordings))
    assert {r.status for r in again.status.filter("session_id IN ('s1','s5')").collect()} == {"skipped"}

    with (recordings / "-p-b" / "s5.jsonl").open("a") as f:
        f.write(user("k2", 3, "more") + "\n")
    third = refresh(store, str(recordings))
    assert {r.session_id for r in third.status.filter("status = 'extracted'").collect()} == {"s5"}
    t = store.tables()
    assert t["turns"].filter("session_id = 's5'").count() == 2
    assert t["turns"].filter("session_id = 's1'").count() == 4
    # A session replaced without tags loses those it had.
    assert {r.session_id for r in t["session_tags"].collect()} == {"s1"}

    counts = run("session_counts", t, Scope(project="/p/a", as_of="2024-03-02"))
    corpus = counts.rows.filter("period = 'corpus'").first()
    assert (corpus.sessions, corpus.turns) == (2, 5)
    assert "project=/p/a" in counts.citation


def test_lines_are_numbered_across_pieces_of_a_file(spark, tmp_path):
    lines = [f'{{"n":{i},"t":"{"x" * (i % 50)}"}}' for i in range(500)]
    write(tmp_path / "in" / "f.jsonl", lines)
    write(tmp_path / "in" / "g.jsonl", lines[:7] + [""] + lines[7:9])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = numbered_lines(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = sorted((r.line_no, r.raw) for r in got if r.file.endswith("f.jsonl"))
    assert whole == list(enumerate(lines, start=1))
    other = sorted((r.line_no, r.raw) for r in got if r.file.endswith("g.jsonl"))
    assert other == list(enumerate(lines[:7] + [""] + lines[7:9], start=1))


def test_projects_are_listed(spark, recordings):
    files = listing(spark, str(recordings))
    rows = projects(files, "2030-01-01").collect()
    assert {(r.project_folder, r.sessions, r.recent_sessions) for r in rows} == {
        ("-p-a", 2, 0), ("-p-b", 4, 0)}


def test_older_frames_take_todays_columns(spark):
    old = spark.createDataFrame(
        [("k", "s", "r", None, "auto", 1, 2, 3)],
        "id string, session_id string, source string, timestamp timestamp, trigger string, "
        "pre_tokens long, post_tokens long, duration_ms long",
    )
    runs = spark.createDataFrame(
        [("s", "r", True, None)], "session_id string, id string, is_fork boolean, started_at timestamp"
    )
    assert migrated(old, "compactions", 8, runs).first().replayed
    with pytest.raises(ValueError):
        migrated(old, "compactions", 99)


def test_arriving_files_wake_a_refresh(spark, tmp_path):
    from sessionlake.streaming.refresh import refresh_stream

    root = tmp_path / "projects"
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    write(root / "-p" / "n1.jsonl", [user("k1", 1, "first")])
    for session, turns in (("n1", 1), ("n2", 2)):
        query = refresh_stream(spark, store, str(root), str(tmp_path / "cp"))
        query.awaitTermination(200)
        assert query.exception() is None
        assert store.tables()["turns"].count() == turns, session
        write(root / "-p" / "n2.jsonl", [user("k2", 1, "second")])


def test_a_grown_file_is_read_again(spark, tmp_path):
    from sessionlake.streaming.refresh import refresh_stream

    root = tmp_path / "projects"
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    for turns in (1, 2):
        write(root / "-p" / "n1.jsonl", [user(f"k{k}", k, "said") for k in range(1, turns + 1)])
        query = refresh_stream(spark, store, str(root), str(tmp_path / "cp"))
        query.awaitTermination(200)
        assert query.exception() is None
        assert store.tables()["turns"].count() == turns


def test_undeclared_fields_are_named_by_path(spark):
    from sessionlake.ingest.records import parsed
    from sessionlake.ingest.unknown import unknown_fields

    records = [
        {"type": "user", "odd": 1, "origin": {"kind": "human", "who": 2}, "message": {"role": "user", "content": [
            {"type": "tool_result", "tool_use_id": "t", "content": "x", "extra": 1}, {"type": "mystery", "y": 1}]}},
        {"type": "assistant", "message": {"role": "assistant", "usage": {"input_tokens": 1, "new": {}, "cache_creation": {"z": 1}}}},
        {"type": "mode", "whatever": 1},
    ]
    rows = [("s", "main", k, json.dumps(r)) for k, r in enumerate(records)]
    lines = parsed(spark.createDataFrame(rows, "session_id string, source string, line_no int, raw string"))
    assert {r.name for r in unknown_fields(lines).collect()} == {
        "user.odd", "user.origin.who", "user.message.content.tool_result.extra",
        "assistant.message.usage.new", "assistant.message.usage.cache_creation.z",
    }


def tags(spark, pairs):
    from sessionlake import schema

    rows = spark.createDataFrame([(s, "k", v) for s, v in pairs], "session_id string, key string, value string")
    return {"session_tags": rows.select(*schema.ALL_TABLES["session_tags"].names)}, rows.select("session_id")


def test_two_writers_and_a_merge(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"), buckets=3)
    store.replace(*tags(spark, [(f"s{k}", "a") for k in range(9)]))
    write_once, met = Store._write, []

    def overtaken(self, rows, name, version):
        write_once(self, rows, name, version)
        if not met:  # another writer commits while this one still writes
            met.append(1)
            Store(spark, str(tmp_path / "store"), buckets=3).replace(*tags(spark, [("s1", "b"), ("s8", "b")]))

    monkeypatch.setattr(Store, "_write", overtaken)
    store.replace(*tags(spark, [("s2", "c")]))
    want = {f"s{k}": "a" for k in range(9)} | {"s1": "b", "s8": "b", "s2": "c"}
    read = lambda: {r.session_id: r.value for r in store.table("session_tags").collect()}
    assert read() == want
    store.merge()
    assert read() == want
    assert store.manifest().filter("relation = 'session_tags'").select("version").distinct().count() == 1
    one = store.table("session_tags", ["s2"])
    assert [r.value for r in one.collect()] == ["c"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]


def test_a_newer_store_is_refused_and_an_older_one_migrated(spark, tmp_path):
    root = tmp_path / "store"
    store = Store(spark, str(root), buckets=2)
    store.replace(*tags(spark, [("s1", "a"), ("s2", "a")]))
    (name,) = (root / "manifests").glob("*.csv")
    older = name.with_name(name.name.replace("-v11", "-v7"))
    older.write_text(name.read_text())
    name.unlink()
    assert store.table("session_tags").count() == 2
    store.replace(*tags(spark, [("s1", "b")]))
    assert sorted(r.value for r in store.table("session_tags").collect()) == ["a", "b"]
    assert store._last()[1] == 11
    last = max((root / "manifests").glob("*.csv"))
    last.with_name("000000000099-v12.csv").write_text(last.read_text())
    with pytest.raises(ValueError, match="newer"):
        store.table("session_tags")


def test_a_write_costs_what_it_replaces(spark, tmp_path, monkeypatch):
    """Layers: bytes written follow the sessions replaced, readers see the same before and after merges."""
    monkeypatch.setattr("sessionlake.sources.store.FAN", 3)
    root = tmp_path / "store"
    store = Store(spark, str(root), buckets=3)
    size = lambda: sum(f.stat().st_size for f in (root / "tables" / "session_tags").rglob("*.parquet"))
    store.replace(*tags(spark, [(f"s{k:05d}", str(k)) for k in range(20_000)]))
    first, want = size(), {f"s{k:05d}": str(k) for k in range(20_000)}
    read = lambda s=None: {r.session_id: r.value for r in store.table("session_tags", s).collect()}
    layers = []
    for turn in range(7):
        names = [f"s{(turn * 7 + k) % 12:05d}" for k in range(5)] + [f"t{turn}"]
        store.replace(*tags(spark, [(n, f"{n}-{turn}") for n in names]))
        want |= {n: f"{n}-{turn}" for n in names}
        layers.append(store.manifest().filter("relation = 'session_tags'").count())
        assert read() == want
        some = ["s00000", "s00011", f"t{turn}", "s19999", "none"]
        assert read(some) == {n: want[n] for n in some if n in want}
        by_join = spark.createDataFrame([(n,) for n in some], "session_id string")
        assert read(by_join) == read(some)
    assert max(layers) <= 5 and min(layers[2:]) < max(layers)
    assert size() - first < first
    # Sessions that are replaced by nothing are gone, also once their layer has been merged.
    empty = tags(spark, [])[0]
    gone = spark.createDataFrame([("s00001",), ("t3",)], "session_id string")
    store.replace(empty, gone)
    del want["s00001"], want["t3"]
    assert read() == want
    store.compact(), store.merge()
    assert read() == want
    assert store.manifest().filter("relation = 'session_tags'").count() == 1


def test_only_due_files_are_opened(spark, tmp_path, monkeypatch):
    from sessionlake.sources import discover

    root = tmp_path / "in"
    for k in range(12):
        write(root / "-p" / f"s {k}%[a].jsonl", [user(f"u{k}", 1, "said")])
    files = listing(spark, str(root))
    due = files.filter(F.col("session_id").isin("s 3%[a]", "s 7%[a]"))
    base = spark.read.option("recursiveFileLookup", "true").text(str(root))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for most, opened in ((1, 0), (100, 2)):
            monkeypatch.setattr(discover, "MOST_PATHS", most)
            monkeypatch.setattr(discover, "PATHS_AT_ONCE", 1)
            read = discover.only(base, due, "value")
            assert read.count() == 2
            if not opened:
                continue
            leaves = read._jdf.queryExecution().executedPlan().collectLeaves()
            counted = [leaves.apply(k).metrics().get("numFiles") for k in range(leaves.size())]
            read.collect()
            scans = [m.get().value() for m in counted if m.isDefined()]
            assert sum(scans) == opened
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for most in (1, 100):
        monkeypatch.setattr(discover, "MOST_PATHS", most)
        assert {r.line_no for r in numbered_lines(spark, str(root), files=due).collect()} == {1}
    assert {r.file.split("/")[-1] for r in numbered_lines(spark, str(root), files=due).collect()} == {
        "s 3%[a].jsonl", "s 7%[a].jsonl"}
    assert numbered_lines(spark, str(root), files=due.limit(0)).collect() == []


def test_a_refresh_lists_the_root_once_for_files_and_once_for_lines(spark, recordings, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    lists = []
    for name in ("load", "text"):
        def counted(self, path=None, *rest, _read=getattr(DataFrameReader, name), **how):
            if isinstance(path, str) and path.startswith(str(recordings)):
                lists.append(path)
            return _read(self, path, *rest, **how)

        monkeypatch.setattr(DataFrameReader, name, counted)
    store = Store(spark, str(tmp_path / "archive"), buckets=2)
    refresh(store, str(recordings))
    assert len(lists) == 2
    assert store.table("agent_runs").count() > 0


def test_most_of_a_root_is_read_without_a_list_of_paths(spark, tmp_path, monkeypatch):
    from sessionlake.sources import discover

    root = tmp_path / "in"
    for k in range(6):
        write(root / "-p" / f"s{k}.jsonl", [user(f"u{k}", 1, "said"), "", user(f"v{k}", 2, "more")])
        write(root / "-p" / f"s{k}" / "tool-results" / "out.txt", [f"printed {k}"])
    due = listing(spark, str(root)).filter(F.col("session_id") != "s2").select("session_id").distinct()
    monkeypatch.setattr(discover, "MOST_PATHS", 0)
    monkeypatch.setattr(discover, "only", lambda read, files, *c: read.select(*c) if "content" in c[1:] else 1 / 0)
    monkeypatch.setattr(discover, "metas", lambda *_: None)
    found = discover.recorded(spark, str(root), due)
    got = sorted((r.session_id, r.source, r.line_no, r.raw) for r in found.lines.collect())
    want = [(f"s{k}", "main", n, raw) for k in (0, 1, 3, 4, 5)
            for n, raw in ((1, user(f"u{k}", 1, "said")), (2, ""), (3, user(f"v{k}", 2, "more")))]
    assert [(s, n, raw) for s, _, n, raw in got] == [(s, n, raw) for s, _, n, raw in want]
    assert {r.session_id for r in found.offloads.collect()} == {"s0", "s1", "s3", "s4", "s5"}
