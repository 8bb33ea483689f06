from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from sessionlake.llm import spelling
from sessionlake.llm.queries import SQL, op11_reduced_alphabet

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def words_of(docs, slip=199, min_chars=6, min_count=5):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def direct(n, factor=5):
    near = {w: [] for w in n}
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    for size, some in by.items():
        for a in some:
            for b in by.get(size, []) + by.get(size + 1, []):
                if (a < b or len(b) > size) and one_edit(a, b):
                    near[a].append(b), near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def told(df):
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("symbols", [1, 2, 4, 9])
@pytest.mark.parametrize("signs", ["ab", "abcé÷x"])
def test_all_pairs_of_tight_words(spark, symbols, signs):
    """Words of few letters, where edits lie in runs, at both ends, and in the middle."""
    rng = random.Random(len(signs))
    made = {"".join(rng.choice(signs) for _ in range(rng.randint(6, 9))) for _ in range(150)}
    rows = [(w, rng.choice([5, 6, 25, 30, 125, 700])) for w in sorted(made)]
    words = spark.createDataFrame(rows, "word string, n long")
    assert told(spelling.grouped(words, symbols=symbols)) == direct(dict(rows))


@pytest.mark.parametrize("min_chars", [3, 4, 7])
def test_other_lengths(spark, texts, documents, min_chars):
    some = documents.filter("doc_id < 40")
    found = spelling.counted(some, min_chars, 3, None)
    n = words_of([t for t in texts if t[0] < 40], None, min_chars, 3)
    assert {r.word: r.n for r in found.collect()} == n
    assert told(spelling.grouped(found, min_chars, 2)) == direct(n, 2)


def test_query_against_all_pairs(spark, folder, texts):
    assert told(op11_reduced_alphabet(spark, folder)) == direct(words_of(texts))


def test_long_chains_lead_to_one_root(spark):
    rows = [("aaaaaa" + "b" * k, 5 ** (k + 1)) for k in range(20)]
    got = told(spelling.grouped(spark.createDataFrame(rows, "word string, n long")))
    assert {r[2] for r in got} == {rows[-1][0]} and got == direct(dict(rows))


def test_odd_rows_and_none(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    found = spelling.counted(odd, slip=199)
    n = words_of(docs)
    assert {r.word: r.n for r in found.collect()} == n
    assert told(spelling.grouped(found)) == direct(n)
    every = spelling.counted(odd, min_count=1)
    assert max(len(r.word) for r in every.collect()) == 300_000
    assert spelling.grouped(spelling.counted(none)).collect() == []


def test_very_long_words_one_edit_apart(spark):
    rows = [("x" * 20_000, 5), ("x" * 19_999 + "y", 50), ("x" * 20_001, 500)]
    got = told(spelling.grouped(spark.createDataFrame(rows, "word string, n long")))
    assert got == direct(dict(rows))


def test_sql_gives_the_same(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    rows = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({SQL['op11_reduced_alphabet']})").fetchall()
    assert Counter(rows) == told(op11_reduced_alphabet(spark, folder))
