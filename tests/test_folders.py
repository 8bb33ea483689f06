"""Files listed and read by tasks, against what Spark's own readers say of the same folders."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sessionlake.sources import discover, folders, tail
from sessionlake.sources.store import Store, refresh
from tests.test_store import user, write

ODD = (
    "-p/s 3%[a].jsonl", "-p/a+b é.jsonl", "-p/.hidden.jsonl", "-p/_left.jsonl", "-p/_x=1.jsonl", "-p/_metadata_z.jsonl",
    "top.jsonl", "_top.jsonl", "-p/s1/subagents/agent-q^{z}.jsonl", "-p/s1/.git/x.jsonl", "-p/_tmp/y.jsonl",
    "-p/s1/tool-results/out 1%.txt", "-p/s1/tool-results/z._COPYING_", "-p/s1/a/b/c/d.txt", "-p/q?#`|<>\".jsonl",
    "-p/b\\c.jsonl", "-p/日 本.jsonl", "-p/s1/subagents/workflows/wf_1/journal.jsonl", "-p/ x.jsonl",
)


@pytest.fixture()
def odd(tmp_path):
    root = tmp_path / "pro j"
    for name in ODD:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\xef\xbb\xbfone\ntwo\xff\r\n\n\nlast" + name.encode())
    (root / "-p" / "empty.jsonl").touch()
    long = b"".join(b"x" * (k % 97) + b"\n" for k in range(5_000)) + b"\xef\xbb\xbf" + b"y" * 30_000
    (root / "-p" / "long.jsonl").write_bytes(long)
    os.symlink(root / "-p" / "s1", root / "-p" / "linked")
    os.symlink(root / "nowhere", root / "-p" / "dangling.jsonl")
    return root


def test_a_listing_names_what_sparks_readers_would_and_hands_the_driver_no_files(spark, odd):
    told = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(odd))
    want = {(r[0], r[1], r[2]) for r in told.select(
        discover._decoded(F.col("_metadata.file_path")), "modificationTime", "length").collect()}
    assert len(want) == 17
    for root in (str(odd), f"file://{odd}/"):
        files = discover.listing(spark, root)
        assert files.inputFiles() == []
        rows = files.collect()
        assert {(r.file, r.modificationTime, r.length) for r in rows} == want and len(rows) == len(want)
        roles = {r.file.split("pro j/")[1]: r.role for r in rows}
        assert roles["-p/s1/subagents/workflows/wf_1/journal.jsonl"] == "journal"
        assert (roles["-p/linked/tool-results/out 1%.txt"], roles["top.jsonl"]) == ("offload", "unknown")


def test_lines_are_those_of_sparks_reader_whatever_the_pieces(spark, odd):
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    told = text.text(str(odd)).select(discover._decoded(F.col("_metadata.file_path")), F.hex("value"))
    want = sorted(map(tuple, told.collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for step in ("1g", "20k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", step)
            lines = discover.numbered_lines(spark, str(odd))
            rows = lines.select("file", "line_no", F.hex("raw").alias("raw")).collect()
            assert sorted((r.file, r.raw) for r in rows) == want
            long = sorted((r.line_no, len(r.raw) // 2) for r in rows if r.file.endswith("/long.jsonl"))
            assert long == [(k + 1, k % 97) for k in range(5_000)] + [(5_001, 30_003)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_root_named_by_a_url_is_refreshed(spark, tmp_path):
    for k in range(3):
        write(tmp_path / "in" / "-p" / f"s{k}.jsonl", [user(f"u{k}", 1, "said")])
        write(tmp_path / "in" / "-p" / f"s{k}" / "tool-results" / "out.txt", [f"printed {k}"])
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    done = refresh(store, f"file://{tmp_path}/in")
    assert {(r.session_id, r.project_folder, r.status) for r in done.status.collect()} == {
        (f"s{k}", "-p", "extracted") for k in range(3)}
    assert sorted(r.content for r in store.table("offload_files").collect()) == [f"printed {k}\n" for k in range(3)]
    again = refresh(store, f"{tmp_path}/in")
    assert {r.status for r in again.status.collect()} == {"skipped"}


def test_no_step_of_a_refresh_hands_the_driver_files_of_the_root(spark, tmp_path, monkeypatch):
    for k in range(3):
        write(tmp_path / "in" / "-p" / f"s{k}.jsonl", [user(f"u{k}", 1, "said")])
    seen = []
    for name in ("listing", "numbered_lines", "offload_files", "metas"):
        def told(*given, _read=getattr(discover, name), **more):
            seen.append(_read(*given, **more))
            return seen[-1]

        monkeypatch.setattr(discover, name, told)
    found = discover.recorded(spark, str(tmp_path / "in"))
    assert found.lines.count() == 3 and len(seen) == 4
    assert not [f for frame in seen for f in frame.inputFiles() if f"{tmp_path}/in" in f]


def test_a_root_that_is_not_there_is_said_so(spark, tmp_path):
    with pytest.raises(Exception, match="none"):
        discover.listing(spark, str(tmp_path / "none")).collect()


def test_a_last_line_without_a_feed_is_read_once(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"a\nbb\n" + b"c" * 10)
    for step in range(1, 20):
        got = [
            raw for part in tail.parts(tail.Stretch(str(path), 0, 15), step)
            for batch in tail.lines_of(part, tail=True) for raw in batch.column("raw").to_pylist()
        ]
        assert got == ["a", "bb", "c" * 10], step
    assert not folders.hidden("_metadata", True) and folders.hidden("_metadata", False)
