from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sessionlake.llm import target
from sessionlake.llm.queries import SQL, op13_target_resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def grams(text, longest=2):
    words = WORD.findall((text or "").translate(FOLD))
    return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def direct(docs, wanted, percent=25, least=20, seed=7, longest=2, buckets=10_000):
    """Every row's (doc_id, n_features, weight, score, rank), one document after the other."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for _, x in rows for g in grams(x, longest)[1]) for rows in (docs, wanted))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(
        1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))
    )
    rows = []
    for doc_id, text in docs:
        words, found = grams(text, longest)
        weight = sum(gain(bucket(g)) for g in found) // len(found) if found else 0
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((len(words) >= least, doc_id, len(found), weight, score))
    fit = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    most = percent * len(fit) // 100
    drawn = [(*r[1:], k + 1) for k, r in enumerate(fit[:most])]
    return Counter([*drawn, *[(*r[1:], None) for r in fit[most:]], *[(*r[1:], None) for r in rows if not r[0]]])


def told(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_checksums_of_any_length():
    rng = np.random.default_rng(4)
    raw = rng.integers(0, 256, 400_000, np.uint8)
    sizes = np.array([*range(1, 300), 4095, 4096, 4097, 65_537, 1, 300_000, *rng.integers(1, 130, 4000)])
    begins = np.array([int(rng.integers(0, len(raw) - n + 1)) for n in sizes])
    got = target.checksums(raw, begins, sizes)
    assert got.tolist() == [zlib.crc32(raw[b : b + n].tobytes()) for b, n in zip(begins, sizes, strict=True)]
    assert target.length_constants(np.array([0])).tolist() == [0]
    zeros = np.zeros(1 << 20, np.uint8)
    assert target.checksums(zeros, np.array([0]), np.array([len(zeros)]))[0] == zlib.crc32(zeros.tobytes())


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_buckets_of_features(texts, longest, monkeypatch):
    monkeypatch.setattr(target, "SPREAD", 5000)
    rng = random.Random(2)
    odd = ["".join(rng.choice("aZ09 .,-_\né日'") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    every = ["", " ", ".", "One", "x" * 500 + " y", *odd, *[t or "" for _, t in texts[:50]], "ends", "Begins"]
    bucket, counts, words = target.features(pa.array(["skipped", *every]).slice(1), longest, 10_000)
    at = 0
    for text, n, w in zip(every, counts.tolist(), words.tolist(), strict=True):
        expected = grams(text, longest)
        assert w == len(expected[0])
        assert sorted(bucket[at : at + n]) == sorted(zlib.crc32(g.encode()) % 10_000 for g in expected[1])
        at += n
    assert at == len(bucket)


def test_query_against_a_direct_reading(spark, folder, texts):
    wanted = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = op13_target_resampling(spark, folder)
    assert told(rows) == direct(texts, wanted)


def test_odd_rows_ties_and_none(spark, odd, none, benchmark):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    wanted = [(r.item_id, r.text) for r in benchmark.collect()]
    for percent in (25, 60, 100):
        assert told(target.drawn(odd, benchmark, percent=percent)) == direct(docs, wanted, percent=percent)
    assert told(target.drawn(odd, none, min_words=1, longest=3)) == direct(docs, [], least=1, longest=3)
    assert target.drawn(none, benchmark).collect() == []


def test_ties_at_the_last_place(spark, benchmark):
    """Rows of one id tie wherever the draw ends; equal scores of different ids go by the smaller id."""
    text = " ".join(f"w{k}" for k in range(30))
    docs = [(5, text)] * 40 + [(k, text) for k in range(1000, 1400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for percent in (3, 10, 50):
        got = target.drawn(df, benchmark, percent=percent)
        assert told(got) == direct(docs, [(r.item_id, r.text) for r in benchmark.collect()], percent=percent)


def test_sql_gives_the_same(spark, folder):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    rows = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({SQL['op13_target_resampling']})").fetchall()
    assert Counter(rows) == told(op13_target_resampling(spark, folder))
