"""Lines on their way to the relations."""

from __future__ import annotations

from tests.test_store import user


def test_lines_are_put_in_order_without_their_texts(spark, monkeypatch):
    from sessionlake.ingest import pipeline

    seen = []
    for name in ("resolve_duplicates", "mark_replays", "assign_turns"):
        def watched(lines, *rest, _step=getattr(pipeline.L, name)):
            seen.append(set(lines.columns))
            return _step(lines, *rest)

        monkeypatch.setattr(pipeline.L, name, watched)
    raw = [("s", "main", 1, user("u1", 1, "x")), ("s", "main", 1, user("u1", 1, "x")), ("s", "main", 2, user("u2", 2, "y"))]
    lines = spark.createDataFrame(raw, "session_id string, source string, line_no int, raw string")
    metas = spark.createDataFrame([], "session_id string, agent_id string, workflow_id string, agentType string, "
                                  "description string, model string, toolUseId string, parentAgentId string, "
                                  "spawnDepth int, isFork boolean")
    paths = spark.createDataFrame([("s", "/t/s.jsonl")], "session_id string, transcript_path string")
    out = pipeline.extract(lines, metas, paths)
    assert len(seen) == 3 and not any({"raw", "rec", "blocks", "prompt"} & columns for columns in seen)
    # Two lines of one place stay two, and each has its text once.
    assert sorted(r.prompt for r in out.tables["turns"].collect()) == ["x", "x", "y"]
    assert out.lines.count() == 3 and out.tables["raw_records"].count() == 3
