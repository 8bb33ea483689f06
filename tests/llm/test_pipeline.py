from __future__ import annotations

import corpus_pipeline
from sessionlake.llm import importance, leaks, near, private
from sessionlake.llm.queries import QUERIES
from tests.llm import brute


def test_stages_follow_each_other(spark, folder, documents):
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == documents.columns, name
        rows = after.collect()
        seen.append({r.doc_id: r.text for r in rows})
        assert len(seen[-1]) == len(rows) <= docs.count()
        docs = spark.createDataFrame(rows, documents.schema)
    chosen, single, clean, masked = seen
    kept = importance.resample(documents, spark.read.parquet(f"{folder}/labels.parquet"))[0].where("kept")
    assert chosen.keys() == {r.doc_id for r in kept.collect()}
    assert single.keys() == set(brute.classes(list(chosen.items())).values())
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert clean.keys() == {i for i, t in single.items() if not brute.leaks(t, items)[4]}
    assert masked == {i: private.masked_text(t) for i, t in clean.items()}


def test_pipeline_packs_what_the_stages_keep(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_odd_rows_and_none(spark, odd, none, folder, labels, benchmark):
    for docs in (odd, none):
        out = importance.resampled(docs, labels)
        out = leaks.without_leaks(near.without_near_duplicates(out), benchmark)
        assert private.masked(out).columns == docs.columns
        private.masked(out).count()
