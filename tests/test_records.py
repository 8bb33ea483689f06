"""What counts as a record, and what a tool's answer says, whatever their size or looks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sessionlake.functions.jsons import is_object
from sessionlake.functions.tools import json_field
from sessionlake.ingest.records import parsed, text_of


def test_only_broken_text_is_no_object(spark):
    cases = {
        '{"type":"user","prNumber":"x"}': True, '{"type":"a","type":"b"}': True, ' {"a":1} ': True,
        "[1]": False, "": False, "{'a':1}": False, '{"a":[1,2}': False, "x {}": False,
        json.dumps({"type": "user", "message": {"content": "y" * (20 << 20)}}): True,
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want boolean")
    assert rows.filter(is_object(F.col("raw")) != F.col("want")).count() == 0
    record = parsed(rows).filter(F.length("raw") > 1 << 20).select(F.length("rec.message.content"))
    assert record.first()[0] == 20 << 20


def test_a_long_input_keeps_its_members(spark):
    asked = json.dumps({"content": "z" * (21 << 20), "file_path": "/a/b.py", "todos": [1]})
    row = spark.createDataFrame([(asked,)], "input string").select(json_field(F.col("input"), "file_path"))
    assert row.first()[0] == "/a/b.py"


def test_a_text_that_looks_like_a_list_stands_as_it_is(spark):
    contents = ['[{"number":1,"title":"x"}]', "[]", [], [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]]
    lines = [
        (json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "content": c}]}}), k)
        for k, c in enumerate(contents)
    ]
    read = parsed(spark.createDataFrame(lines, "raw string, k int")).select("k", F.explode("blocks").alias("b"))
    said = {r.k: r.text for r in read.select("k", text_of(F.col("b")).alias("text")).collect()}
    assert said == {0: contents[0], 1: "[]", 2: "", 3: "ab"}


def test_unknown_parts_of_results_are_seen(spark):
    from sessionlake.ingest.records import ADVISOR_RESULTS, RESULT_PARTS, odd_kind

    rows = [
        ([json.dumps({"type": "text"}), json.dumps({"type": "image"})], False), ([], False), (None, False),
        ([json.dumps({"type": "text"}), json.dumps({"type": "video"})], True), ([json.dumps({"text": "x"})], True),
    ]
    df = spark.createDataFrame(rows, "parts array<string>, want boolean")
    assert df.filter(odd_kind(F.col("parts"), RESULT_PARTS) != F.col("want")).count() == 0
    told = F.array(F.lit('{"type":"advisor_tool_result_error","error_code":"x"}'))
    assert not df.select(odd_kind(told, ADVISOR_RESULTS)).first()[0]


def test_failed_calls_of_any_id_find_their_line(spark):
    from sessionlake import schema
    from sessionlake.operators.relations import Tables
    from sessionlake.operators.sheets import error_records

    ids = ["toolu_ab1", "call-7.x", "x y"]
    raw = [("s", "main", k, json.dumps({"id": i})) for k, i in enumerate(ids, 1)] + [("s", "main", 9, json.dumps({"n": {"ref": "x y"}}))]

    def table(name, rows):
        shape = schema.ALL_TABLES[name]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields)
        return spark.createDataFrame([tuple(r.get(c) for c in shape.names) for r in rows], kinds)

    frames = {n: table(n, []) for n in schema.ALL_TABLES}
    frames["raw_records"] = table("raw_records", [dict(zip(("session_id", "source", "line_no", "raw"), r, strict=True)) for r in raw])
    base = {"session_id": "s", "source": "main", "name": "T", "is_error": True, "result": "no", "replayed": False}
    frames["tool_calls"] = table("tool_calls", [base | {"id": i, "index": k} for k, i in enumerate(ids)])
    found = {r.tool_call_id: r.line_no for r in error_records(Tables(frames)).collect()}
    assert found == {"toolu_ab1": 1, "call-7.x": 2, "x y": 9}
