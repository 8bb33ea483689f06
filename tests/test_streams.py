"""Streams against batch readings: silences in any order of arrival, and transcripts line by line."""

from __future__ import annotations

import json
import random
import time
from collections import Counter

import pandas as pd
import pytest

from sessionlake import schema
from sessionlake.sources import tail
from sessionlake.sources.store import Store, refresh
from sessionlake.streaming.refresh import GapDetector, append_stream, idle_gap_stream
from tests.test_store import record, reply, user, write

SHAPE = (
    "session_id string, source string, index int, started_at timestamp, cache_creation_tokens long, "
    "cache_read_tokens long, cache_1h_tokens long"
)


def ran(query):
    query.awaitTermination(300)
    assert query.exception() is None
    return query


def silences(calls, least):
    """(session, source, start, end, idle, tokens) from a batch of calls, thread by thread."""
    threads, want = {}, Counter()
    for c in calls:
        threads.setdefault((c[0], c[1]), []).append(c)
    for key, rows in threads.items():
        rows.sort(key=lambda c: (c[3], c[2]))
        for a, b in zip(rows, rows[1:], strict=False):
            idle = int(b[3].timestamp()) - int(a[3].timestamp())
            if idle >= least:
                want[(*key, a[3], b[3], idle, b[4])] += 1
    return want


def streamed(spark, folder, batches, least, late):
    """What the stream says of batches that come one after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{folder}/in/b{k:03d}")
        time.sleep(0.05)
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    ran(
        idle_gap_stream(stream, least, late=late).writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).outputMode("append").start()
    )
    out = spark.read.parquet(f"{folder}/out").collect()
    return Counter((r.session_id, r.source, r.gap_start, r.started_at, r.idle_seconds, r.rebuilt_tokens) for r in out)


def at(seconds):
    return pd.Timestamp("2024-01-01", tz="UTC").to_pydatetime().astimezone().replace(tzinfo=None) + pd.Timedelta(
        seconds=seconds
    ).to_pytimedelta()


def test_any_order_within_the_delay_gives_the_batch_rows(spark, telemetry, tmp_path):
    rows = [tuple(r) for r in telemetry.live("api_calls").select(*[c.split()[0] for c in SHAPE.split(", ")]).collect()]
    random.Random(4).shuffle(rows)
    far = max(r[3] for r in rows) + pd.Timedelta(days=400).to_pytimedelta()
    batches = [rows[k::3] for k in range(3)] + [rows[:50], [("end", "main", 0, far, 0, 0, 0)]]
    got = streamed(spark, str(tmp_path), batches, 20_000, "300 days")
    want = silences(rows, 20_000)
    assert want and got == want


def test_late_calls_are_placed_or_left_out_but_never_make_a_silence(spark, tmp_path):
    call = lambda s, i, thread="main": ("s", thread, i, at(s), i, 0, 0)
    batches = [[call(1000, 2)], [call(100, 1)], [call(1010, 3)], [call(5000, 4)], [call(5001, 5)], [call(900, 9)],
        [call(99_000, 5, "x")]]
    got = streamed(spark, str(tmp_path), batches, 60, "1000 seconds")
    # The call at 900 came after all before 4000 had been settled.
    kept = [c for b in batches for c in b if c[2] != 9]
    assert got == silences(kept, 60)


def test_timers_take_calls_in_order(monkeypatch):
    class Value:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Held(dict):
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__
        getValue = dict.__getitem__

        def exists(self):
            return bool(self)

    class Handle:
        def __init__(self):
            self.timers = set()

        def registerTimer(self, moment):
            self.timers.add(moment)

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

    monkeypatch.setenv("TZ", "America/Caracas")
    time.tzset()
    try:
        detector = GapDetector(min_idle_seconds=10, forget_after=5_000)
        detector.handle, detector.last, detector.waiting = Handle(), Value(), Held()
        second = 1_000_000
        calls = pd.DataFrame(
            [(0, 0), (30, 3), (30, 2), (5, 1), (31, 4)], columns=["at", "index"]
        ).assign(cache_creation_tokens=[0, 3, 2, 1, 4], reloaded=True, cached=[True, False, True, False, False])
        calls["at"] *= second
        assert list(detector.handleInputRows(("s", "main"), iter([calls.iloc[:2], calls.iloc[2:]]), None)) == []
        assert detector.handle.timers == {0, 5_000, 30_000, 31_000}
        told = [r for now in (5_000, 30_999) for df in detector.handleExpiredTimer(("s", "main"), Clock(now), None)
                for r in df.itertuples(index=False, name=None)]
        assert told == [("s", "main", 5 * second, 30 * second, 25, True, 2, False)]
        assert list(detector.waiting) == [(31 * second, 4)]
        list(detector.handleExpiredTimer(("s", "main"), Clock(31_000), None))
        assert detector.last.value == (31 * second, False)
        list(detector.handleExpiredTimer(("s", "main"), Clock(36_000), None))
        assert detector.last.value is None
    finally:
        monkeypatch.undo()
        time.tzset()


@pytest.mark.parametrize("split, piece", [(7, 5), (64, 3), (1 << 20, 1 << 20), (50, 1000)])
def test_every_line_of_a_stretch_once(tmp_path, monkeypatch, split, piece):
    monkeypatch.setattr(tail, "PIECE", piece)
    rng = random.Random(split)
    lines = [b"x" * rng.choice([0, 1, 3, 40, 200]) + bytes([rng.choice([65, 255])]) * rng.randint(0, 2) for _ in range(60)]
    path = tmp_path / "a b%.jsonl"
    path.write_bytes(b"\n".join(lines) + b"\nopen")
    size = path.stat().st_size
    files, where = tail.filesystem(str(path))
    assert tail.last_line_end(files, where, 0, size) == size - 4
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line) + 1)
    for first in (0, 1, 17, 59):
        got = []
        for part in tail.parts(tail.Stretch(str(path), begins[first], size - 4), split):
            for batch in tail.lines_of(part):
                raw = batch.column("raw").cast("binary").to_pylist()
                got += zip(batch.column("at").to_pylist(), raw, strict=True)
        assert got == list(zip(begins[first:-1], lines[first:], strict=True))


def test_a_line_added_to_a_long_file_reads_just_that(tmp_path, monkeypatch):
    root = tmp_path / "in"
    write(root / "-p" / "s1.jsonl", [user(f"u{k}", k % 60, "x" * 5_000) for k in range(2_000)])
    log = tail.Log(str(tmp_path / "log"))
    log.add(tail.grown(str(root), log.positions))
    with (root / "-p" / "s1.jsonl").open("a") as f:
        f.write(user("new", 1, "said") + "\n" + '{"still":')
    reader = tail.LineReader(str(root), str(tmp_path / "log"))
    found = reader.partitions({"round": 1}, reader.latestOffset())
    read = []

    class Counted:
        def __init__(self, files):
            self.files = files

        def open_input_file(self, path):
            source = self.files.open_input_file(path)

            class Source:
                __enter__ = lambda s: s
                __exit__ = lambda s, *e: source.close()
                seek = staticmethod(source.seek)

                @staticmethod
                def read(n):
                    data = source.read(n)
                    read.append(len(data))
                    return data

            return Source()

    rows = [r for p in found for b in tail.lines_of(p, Counted(tail.filesystem(str(root))[0])) for r in b.to_pylist()]
    assert [json.loads(r["raw"])["uuid"] for r in rows] == ["new"]
    assert sum(read) < 500
    # A start from the log alone knows the same positions; nothing new means no new round.
    again = tail.LineReader(str(root), str(tmp_path / "log"))
    assert again.latestOffset() == {"round": 2}
    monkeypatch.setattr(tail, "SNAPSHOT", 1)
    log = tail.Log(str(tmp_path / "log"))
    log.add([tail.Stretch("other", 0, 9)])
    assert tail.Log(str(tmp_path / "log")).positions == log.positions


def whole(store):
    """Every relation that says what was recorded, as rows without their order."""
    left_out = {"extract_state", "read_positions", *schema.ENRICHMENTS, *(n for n in schema.LEDGERS if n != "read_positions")}
    return {
        n: Counter(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in store.table(n).collect())
        for n in schema.ALL_TABLES if n not in left_out
    }


def script(rng, name):
    """A transcript as it is written: prompts, replies in pieces, tools with late results, notes."""
    lines, n = [], 0
    for turn in range(6):
        n += 1
        prompt = f"{name}u{n}"
        lines.append(user(prompt, turn, f"prompt {turn}"))
        for k in range(rng.randint(1, 3)):
            message, tool = f"{name}m{turn}-{k}", f"{name}t{turn}-{k}"
            lines.append(reply(f"{name}a{turn}-{k}x", turn, message, [{"type": "text", "text": "part one, "}], prompt))
            block = {"type": "tool_use", "id": tool, "name": "Read", "input": {"file_path": f"/x/{k}"}}
            lines.append(reply(f"{name}a{turn}-{k}y", turn, message, [{"type": "text", "text": "part two"}, block], prompt))
            answer = [{"type": "tool_result", "tool_use_id": tool, "content": "done"}]
            lines.append(user(f"{name}r{turn}-{k}", turn, answer))
        if rng.random() < 0.5:
            lines.append(json.dumps({"type": "custom-title", "customTitle": f"Title {turn}"}))
        if rng.random() < 0.4:
            lines.append("")
        if rng.random() < 0.3:
            lines.append(record("system", f"{name}d{turn}", turn, subtype="turn_duration", durationMs=1000 * turn))
    return lines


def test_an_archive_kept_up_line_by_line_is_that_of_a_full_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "SPLIT", 700)
    rng = random.Random(12)
    root = tmp_path / "projects"
    store = Store(spark, str(tmp_path / "kept"), buckets=2)
    scripts = {
        root / "-p" / "s1.jsonl": script(rng, "a"), root / "-p" / "s2.jsonl": script(rng, "b"),
        root / "-p" / "s1" / "subagents" / "agent-r1.jsonl": script(rng, "c"),
    }
    meta = root / "-p" / "s1" / "subagents" / "agent-r1.meta.json"
    meta.parent.mkdir(parents=True)
    meta.write_text(json.dumps({"agentType": "helper", "toolUseId": "at1-0", "spawnDepth": 1}))
    told = dict.fromkeys(scripts, 0)

    def compare(name):
        fresh = Store(spark, str(tmp_path / f"full-{name}"), buckets=2)
        refresh(fresh, str(root))
        assert whole(store) == whole(fresh), name

    def follow():
        ran(append_stream(spark, store, str(root), str(tmp_path / "cp")))

    for step in range(3):
        for path, lines in scripts.items():
            if step or "s2" not in path.name:
                upto = len(lines) if step == 2 else min(len(lines), told[path] + rng.randint(1, 9))
                with path.open("a") as f:
                    f.write("".join(line + "\n" for line in lines[told[path] : upto]))
                told[path] = upto
        if step == 0:
            with (root / "-p" / "s1.jsonl").open("a") as f:
                f.write(scripts[root / "-p" / "s1.jsonl"][told[root / "-p" / "s1.jsonl"]][:20])
        follow()
        if step == 0:  # the rest of the line that was cut
            path = root / "-p" / "s1.jsonl"
            with path.open("a") as f:
                f.write(scripts[path][told[path]][20:] + "\n")
            told[path] += 1
            follow()
            positions = {r.file: (r.bytes, r.lines) for r in store.table("read_positions").collect()}
            assert positions[str(path)] == (path.stat().st_size, told[path])
    compare("grown")
    # A uuid said again with other words: the session is refused until the file is put right.
    path = root / "-p" / "s2.jsonl"
    good = path.read_text()
    before = whole(store)
    path.write_text(good + user("bu1", 1, "other words") + "\n")
    follow()
    assert whole(store) == before
    path.write_text(good[: len(good) // 2].rsplit("\n", 1)[0] + "\n")  # shorter than what was read
    follow()
    compare("rewritten")
    # What `refresh` has read in between is not taken up twice.
    with path.open("a") as f:
        f.write(user("bz1", 50, "by refresh") + "\n")
    refresh(store, str(root))
    follow()
    compare("mixed")
