"""What tool calls are called: their inputs are read once, and a tally tells first, names and repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.operators import sheets, tree
from sessionlake.operators.relations import Tables


def test_inputs_are_read_once(telemetry):
    plan = sheets.named_tools(telemetry, 40).select("id", "fields")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_json") <= 3


def test_titles_name_tools_once(telemetry, monkeypatch):
    named, calls = sheets.named_tools, []

    def watched(*args, **kinds):
        calls.append(1)
        return named(*args, **kinds)

    monkeypatch.setattr(sheets, "named_tools", watched)
    monkeypatch.setattr(tree, "named_tools", watched)
    assert tree.titles(telemetry, 40).filter(F.col("title").isNull()).count() == 0
    assert len(calls) == 1


def test_a_tally_with_repeats(spark):
    names = ["Bash", "Read", "Bash", "Edit", "Read", "Bash"]
    tools = spark.createDataFrame(
        [("s", "main", "c", f"k{i}", i, n, '{"command":"ls","file_path":"/p/f","to":"r"}') for i, n in enumerate(names)]
        + [("s", "main", "d", "k9", 0, None, "not json{"), ("s", "main", "d", "k10", 1, None, "{}")],
        "session_id string, source string, api_call_id string, id string, index int, name string, input string",
    )
    twice = [("s", "/p"), ("s", "/p")]  # a session that comes twice counts its tools twice
    t = Tables({
        "tool_calls": tools, "sessions": spark.createDataFrame(twice, "id string, project_dir string"),
        "agent_runs": spark.createDataFrame([("s", "r", "t")], "session_id string, id string, agent_type string"),
    })
    got = {r.api_call_id: r for r in sheets.call_tools_tally(t, 40).collect()}
    assert [(k.name, k.n) for k in got["c"].tally] == [("Bash", 6), ("Read", 4), ("Edit", 2)]
    assert [(k.name, k.n) for k in got["c"].rest] == [("Read", 4), ("Bash", 5), ("Edit", 2)]
    assert (got["c"].first.name, got["c"].first.fields.path, got["c"].first.fields.addressed) == ("Bash", "f", "t")
    assert (got["d"].first.name, got["d"].first.fields.input_head) == (None, "not json{")
