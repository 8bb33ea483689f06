"""Everything above a node, against a direct climb; what lies above runs is found once."""

from __future__ import annotations

from sessionlake.enrich import items
from sessionlake.operators import tree


def climbed(links: list[tuple]) -> set[tuple]:
    found, more = set(), set(links)
    while more:
        found |= more
        more = {(s, n, top) for s, n, a in found for z, m, top in links if (z, m) == (s, a) and None not in (s, a)} - found
    return found


def test_links_to_a_top_are_left_out_of_the_rounds(spark, monkeypatch):
    chain = [("s", f"n{i}", f"n{i + 1}") for i in range(9)] + [("s", "n9", "top")]
    leaves = [("s", f"leaf{i}", "top") for i in range(20)] + [("s", "leaf0", "n3"), ("s", "leaf0", "n3")]
    rings = [("s", "a", "b"), ("s", "b", "a"), ("s", "own", "own"), ("s", "in", "a"), ("s", "b", "out")]
    odd = [("z", "n0", "n1"), ("s", "loose", None), (None, "n0", "n1"), (None, "n1", "n2"), ("s", None, "n2")]
    links = chain + leaves + rings + odd
    rounds = []
    kept = tree.keep

    def watched(df, label):
        rounds.append(kept(df, label))
        return rounds[-1]

    monkeypatch.setattr(tree, "keep", watched)
    got = tree.ancestors(spark.createDataFrame(links, "s string, node string, above string"), ["s"], "node", "above")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == climbed(links)
    assert all(r.above not in ("top", "out", None) for df in rounds[1:-1] for r in df.collect())


def test_links_of_runs_are_found_once(telemetry):
    assert items.run_links(telemetry) is items.run_links(telemetry)
