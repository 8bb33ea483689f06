from __future__ import annotations

import random

import pytest

from sessionlake.operators import containment

LINES = "session_id string, source string, line_no int, raw string"
WORDS = "session_id string, source string, words string"


def direct(lines, words):
    found = set()
    for s, f, w in set(words):
        held = [n for a, b, n, raw in lines if (a, b) == (s, f) and raw is not None and w is not None and w in raw]
        if held and s is not None and f is not None:
            found.add((s, f, w, max(held)))
    return found


@pytest.mark.parametrize("at_once, places", [(1 << 20, 1 << 22), (40, 1 << 22)])
def test_every_id_is_found_where_it_stands(spark, monkeypatch, at_once, places):
    monkeypatch.setattr(containment, "AT_ONCE", at_once)
    rng = random.Random(at_once)
    odd = ['call_9', 'say "hi', "back\\slash", "with blank", "é日本語の長い名前", "", "k1", "k12", "toolu_ABC", "toolu_ABCD",
           '{"content":"say \\"hi","id":"call_9"}', "x" * 300, "12345678", "123456789", "\n", "aaaa", "aaaaaaaaa"]
    signs = ["a", "k", "1", "2", '"', "\\", " ", "é", "日"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 11))) for _ in range(120)]
    lines, words = [], []
    for s in ("s1", "s2", None):
        for f in ("main", "r1"):
            for n in range(30):
                parts = [rng.choice([*odd, *made, "filler "]) for _ in range(rng.randint(0, 5))]
                lines.append((s, f, n, rng.choice(["", "|"]).join(parts) if rng.random() < 0.95 else None))
            words += [(s, f, w) for w in [*odd, *made, None, "never said anywhere"]]
    words += [("s9", "main", "k1")] * 3
    got = containment.last_lines_with(
        spark.createDataFrame(lines, LINES).repartition(5), spark.createDataFrame(words, WORDS)
    )
    rows = [tuple(r[c] for c in ("session_id", "source", "words", "line_no")) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == direct(lines, words)


def test_nothing_asked_or_nothing_there(spark):
    lines = spark.createDataFrame([("s", "main", 1, "x")], LINES)
    assert containment.last_lines_with(lines, spark.createDataFrame([], WORDS)).collect() == []
    one = spark.createDataFrame([("s", "main", "x")], WORDS)
    assert containment.last_lines_with(lines.limit(0), one).collect() == []
