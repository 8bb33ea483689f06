from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import hilbert, importance, leaks, near, private, repeats, rules
from sessionlake.llm.queries import QUERIES, SQL
from tests.llm import brute


@pytest.mark.parametrize("letters", ["a@.b-1", "1.25 3", "+1( )-.23", "0123456789 -.+@a", "49 -"])
def test_base_spans_are_those_of_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert [s for s in private.find(text) if s[0] in private.BASE] == brute.private(text), text


def test_added_spans_and_masking():
    text = "IBAN: DE89 3704 0044 0532 0130 00 ok, SSN 123-45-6789; https://me:secret@host.org tel:+1-202-555-0101 x"
    assert [text[a:b] for k, a, b in private.find(text) if k not in private.BASE] == [
        "DE89 3704 0044 0532 0130 00", "123-45-6789", "me:secret", "+1-202-555-0101",
    ]
    assert private.masked_text("to a@b.co, 10.0.0.1.") == "to [EMAIL], [IP]."
    assert private.find("a" * 200_000 + " " + "1" * 200_000 + "." * 50_000) == []


def test_private_report(documents, texts, odd, none):
    rows = {r.doc_id: r for r in private.report(documents).collect()}
    for i, text in texts:
        base = brute.private(text)
        assert rows[i].base_sha256 == hashlib.sha256(private.written(base).encode()).hexdigest()
        assert rows[i].n_email == sum(k == "email" for k, _, _ in base)
    assert private.report(odd).count() == odd.count() and private.report(none).count() == 0
    masked = private.masked(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count() and private.masked(none).count() == 0
    assert masked.where("doc_id = 11").first().text == "mail [EMAIL] or [IP] é"
    assert masked.where("text is null").count() == odd.where("text is null").count()


def test_leaks(spark, documents, texts, folder, odd, none, benchmark):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [tuple(r) for r in bench.collect()]
    rows = {r.doc_id: r for r in leaks.report(documents, bench).collect()}
    for i, text in texts[:80] + [t for t in texts if rows[t[0]].contaminated]:
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute.leaks(text, items)
    assert any(r.contaminated for r in rows.values())
    split = {tuple(r) for r in leaks.report(documents, bench, most_bytes=30_000).collect()}
    assert split == {tuple(r) for r in rows.values()}
    assert leaks.report(odd, benchmark).count() == odd.count() and leaks.report(none, benchmark).count() == 0
    kept = leaks.without_leaks(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert leaks.report(odd, benchmark.limit(0)).where("contaminated").count() == 0


def test_leaks_spans_and_short_items(spark, benchmark):
    docs = spark.createDataFrame(
        [(1, "A, short--ITEM! one"), (2, "One two THREE four five six seven eight nine (ten) twelve"), (3, "lonely item words"), (4, "shorts item")],
        "doc_id long, text string",
    )
    rows = {r.doc_id: r for r in leaks.scanned(docs, benchmark).collect()}
    assert (rows[1].n_hit, rows[1].items, [tuple(s) for s in rows[1].spans]) == (2, ["2", "5"], [(3, 14)])
    assert (rows[2].n_hit, rows[2].items) == (10, ["1"])
    assert (rows[3].n_hit, rows[3].items, rows[4].n_hit) == (3, [], 0)
    assert [r.doc_id for r in leaks.without_leaks(docs, benchmark).collect()] == [4]


def test_near_duplicates_are_those_of_all_pairs(documents, texts):
    rows = near.near_duplicates(documents).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute.classes(texts)
    assert {r.doc_id for r in rows if r.kept} == {r.class_id for r in rows}


def test_near_duplicates_across_a_hot_bucket(spark):
    """Many near copies of one text, and pairs that only meet beside the bucket's least member."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        docs.append((k, " ".join(words)))
    found = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == brute.classes(docs)


def test_near_duplicates_of_odd_rows_and_of_none(odd, none):
    rows = near.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.class_id for r in rows if r.doc_id in (3, 4, 5, 6)} == {3: 3, 4: 3, 5: 5, 6: 6}
    kept = near.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids == [1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, None]
    assert near.near_duplicates(none).count() == 0 and near.without_near_duplicates(none).count() == 0


def test_signatures_estimate_probability_jaccard():
    import pyarrow as pa

    rng = random.Random(4)
    words = [f"v{k}" for k in range(400)]
    a = " ".join(words[:300] + words[:30])
    b = " ".join(words[20:330])
    text, shingle, weight = near.weighted_shingles(pa.array([a, b]))
    won = near.signatures(text, shingle, weight, 2, 4000)
    bags = [(np.sort(shingle[text == k]), weight[text == k][np.argsort(shingle[text == k])]) for k in (0, 1)]
    exact, _ = near.similarity(*bags)
    keys = [dict(zip(*map(list, bag), strict=True)) for bag in bags]
    shared = keys[0].keys() & keys[1].keys()
    slow = sum(
        1 / sum(max(keys[0].get(o, 0) / keys[0][d], keys[1].get(o, 0) / keys[1][d]) for o in keys[0].keys() | keys[1].keys())
        for d in shared
    )
    assert exact == pytest.approx(slow)
    assert (won[0] == won[1]).mean() == pytest.approx(exact, abs=0.035)
    del rng


def test_repeats(documents, texts, odd, none):
    found = repeats.repeated(repeats.units(documents)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.first_id) for r in found) == brute.repeats(texts)
    clean = {r.doc_id: r for r in repeats.without_repeats(documents).collect()}
    gone = {}
    for i, low, high, _ in brute.repeats(texts):
        gone.setdefault(i, []).append((low, high))
    for i, text in texts:
        assert [tuple(s) for s in clean[i].removed] == gone.get(i, [])
        assert clean[i].text == repeats.cut(text, gone.get(i, []))
    out = repeats.without_repeats(odd)
    assert out.columns == [*odd.columns, "removed", "first_ids"] and out.count() == odd.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].removed == [] and by[10].first_ids == [9] and by[12].first_ids == [10] and by[12].text == ""
    assert by[3].text is None
    assert repeats.without_repeats(none).count() == 0


def test_units():
    text = "a b\nc\n \n\nd e\n\nf"
    assert [(s, e) for _, s, e in repeats.units_of(text, "paragraph", 1)] == [(0, 9), (9, 14), (14, 15)]
    assert [(s, e) for _, s, e in repeats.units_of(text, "line", 1)] == [(0, 4), (4, 6), (9, 13), (14, 15)]
    passage = "One two three four five six seven. Eight nine. Ten! Eleven twelve thirteen fourteen fifteen sixteen."
    one = repeats.units_of(f"Short. {passage} Own words.\nNext")
    two = repeats.units_of(f"Other words before it, which are long enough. {passage.upper()}\nMore")
    shared = {d for d, _, _ in one} & {d for d, _, _ in two}
    assert len(shared) == 4 and len(one) == 6
    assert one[0][1] == len("Short. ") and one[3][2] == len(f"Short. {passage} ")


def test_a_passage_inside_lines_goes_whole(spark):
    passage = "This very passage has more than eight words in it. So it goes. Yes. And its last sentence is long as well, too."
    docs = [(k, f"Document {k} begins with words of its own alone{k}. {passage} Its end{k}.\nLine {k}.") for k in range(40)]
    found = repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    for r in found.collect():
        assert (passage in r.text) == (r.doc_id == 0)
        if r.doc_id:
            assert r.text == docs[r.doc_id][1].replace(passage + " ", "") and set(r.first_ids) == {0}


def test_copies_and_runs_of_short_sentences_go(spark, odd, none, texts, tmp_path):
    shouts = " ".join(f"SHOUT{k}.!!" for k in range(60))
    block = "One two. Three four. Five six. Seven eight. Nine."
    docs = [
        (1, shouts), (2, shouts.lower()), (3, "Yes."), (4, " yes.\n"), (5, f"This sentence of seven words is own five.\n{block}"),
        (6, f"Another sentence of seven words is own six. {block} Tail of six."), (7, f"Hi! {block}\nHi! {block}"),
        (8, "\n\nOnly one sentence of many words stands here."), (9, "Yes. But this one goes on with words.\nYes."),
        (10, None), (11, ""), (2, shouts.lower()),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    by = {r.doc_id: r for r in QUERIES["op1_line_hashing"](spark, str(tmp_path)).collect()}
    assert by[1].text == shouts and by[2].text == "" and by[2].removed == f"0:{len(shouts)}" and by[2].first_ids == "1"
    assert by[3].text == "Yes." and by[4].text == "" and by[10].text is None and by[11].text == ""
    assert all(by[k].text == dict(docs)[k] for k in (5, 8, 9))
    # Joined from the start of the run: its first six words are met, the rest stands after other words.
    assert by[6].text == "Another sentence of seven words is own six. Seven eight. Nine. Tail of six."
    assert by[7].text == f"Hi! {block}\n"
    for docs in (odd, none):
        out = repeats.without_repeats(docs, repeats.NESTED)
        assert out.columns == [*docs.columns, "removed", "first_ids"] and out.count() == docs.count()
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    clean, seen = {r.doc_id: r for r in repeats.without_repeats(rows, repeats.NESTED).collect()}, set()
    for i, text in sorted(texts):
        whole = " ".join((text or "").lower().split())
        assert whole not in seen or not clean[i].text.strip()
        seen |= {whole} - {""}
        spans = [tuple(s) for s in clean[i].removed]
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert clean[i].text == (repeats.cut(text, spans) if text else text)
    # What sentences alone find goes too, and no word is lost from the corpus.
    for i, low, high, _ in brute.repeats(texts):
        assert set(range(low, high)) <= {c for a, b in clean[i].removed for c in range(a, b)}
    words = lambda docs: {w for t in docs for w in (t or "").lower().split()}
    assert words(t for _, t in texts) == words(r.text for r in clean.values())


def test_rules(documents, texts, odd, none):
    rows = {r.doc_id: r for r in rules.judged(documents).collect()}
    for i, text in texts:
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules(text)
        assert r.kept == (not r.base_failed)
    assert rules.judged(odd).count() == odd.count() and rules.judged(none).count() == 0


def test_boilerplate_depletes(spark):
    line = " ".join(f"common{k}" for k in range(20))
    docs = [(k, f"{line}\n" + " ".join(f"own{k}x{j}" for j in range(5 if k < 10 else 60)), "s") for k in range(30)]
    docs += [(100 + k, "copy " * 3 + " ".join(f"c{j}" for j in range(40)), "s") for k in range(50)]
    docs += [(200, docs[0][1], "t")]
    found = rules.judged(spark.createDataFrame(docs, "doc_id long, text string, source string"), limit=25)
    kept = {r.doc_id: (r.kept, r.n_boilerplate_words) for r in found.collect()}
    assert all(kept[k] == (k >= 10, 20) for k in range(30))
    assert all(kept[100 + k] == (True, 0) for k in range(50)) and kept[200] == (True, 0)


def test_boilerplate_lines_are_cut(spark, odd, none):
    line, lead = "Same  LINE of the host é", " ".join(f"lead{j}" for j in range(30))
    docs = [(k, f"{lead} ü{k}\n {line.lower() if k % 2 else line}\t\n\nend {k} of it\n{line}", "s") for k in range(30)]
    docs += [(50, f"{lead}\n{line}\nelsewhere", "t"), (51, None, "s"), (52, "", "s"), (53, f"{line}\n{line}\nlast", "s")]
    docs += [docs[3], (3, docs[3][1], "t"), (None, docs[4][1], "s")]
    docs = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string, fp string")
    by = {(r.doc_id, r.source): r for r in rules.cleaned(docs, limit=25).collect()}
    texts = {(r.doc_id, r.source): r.text for r in docs.collect()}
    for k in range(30):
        r, text = by[k, "s"], texts[k, "s"]
        assert r.text == f"{lead} ü{k}\n\nend {k} of it\n" and r.verdict.kept and r.verdict.n_boilerplate_words == 12
        assert [" ".join(text[a:b].split()).lower() for a, b in r.verdict.removed] == ["same line of the host é"] * 2
    assert by[None, "s"].text == by[4, "s"].text and by[51, "s"].text is None and by[52, "s"].text == ""
    assert by[53, "s"].text == "last" and not by[53, "s"].verdict.kept
    assert all(by[k, "t"].text == texts[k, "t"] and by[k, "t"].verdict.removed == [] for k in (50, 3))
    out = rules.without_boilerplate(docs, limit=25)
    assert out.columns == [*docs.columns, "removed"] and out.count() == 30 + 1 + 1 + 1 + 1
    assert rules.cleaned(odd).count() == odd.count() and rules.cleaned(none).count() == 0
    assert rules.cleaned(odd).columns == [*odd.columns, "verdict"]


def test_default_limit_is_met_on_a_host_of_ordinary_size(spark, tmp_path):
    line, few = (" ".join(f"{name}{k}" for k in range(20)) for name in ("menu", "rare"))
    own = [" ".join(f"own{k}x{j}" for j in range(5 if k == 0 else 60)) for k in range(50)]
    docs = [(k, (f"{line}\n" if k < 12 else f"{few}\n" if k < 22 else "") + own[k], "s") for k in range(50)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    by = {r.doc_id: r for r in QUERIES["op5_line_frequency"](spark, str(tmp_path)).collect()}
    assert [k for k, r in by.items() if not r.kept] == [0]
    assert all(by[k].text == (own[k] if k < 12 else docs[k][1]) for k in range(50))
    assert all(by[k].removed == (f"0:{len(line) + 1}" if k < 12 else "") for k in range(50))


def test_repeat_words_by_doubling():
    rng = random.Random(1)
    lists = [[rng.randrange(3) for _ in range(rng.randint(0, 60))] for _ in range(200)]
    got = rules.repeat_words([np.array(x, np.int64) for x in lists])
    assert list(got) == [brute.rules(" ".join(map(str, x)))[4] for x in lists]


@pytest.mark.parametrize("bits, n", [(1, 2), (2, 2), (3, 3), (2, 4), (5, 2)])
def test_curve_visits_neighbours(bits, n):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    index = hilbert.curve_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards(documents, odd, none, tmp_path):
    import zlib

    for docs in (documents, odd):
        rows = hilbert.placed(docs).collect()
        assert len(rows) == docs.count()
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by.get(k, [])) for k in range(16)]
        assert max(sizes) - min(sizes) <= 1
        facts = sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows)
        raw = [(r.doc_id or -1, (r.text or "").encode()) for r in docs.collect()]
        assert facts == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in raw)
    assert hilbert.placed(none).count() == 0
    hilbert.write_shards(documents.select("doc_id", "text", "source", "lang", "n_chars"), str(tmp_path / "shards"), shards=4)
    back = documents.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 4
    # A shard holds few of the sources, where a deal by chance would hold all.
    held = back.groupBy("shard").agg(F.count_distinct("source").alias("n")).agg({"n": "avg"}).first()[0]
    assert held < documents.select("source").distinct().count()


def test_importance_keeps_clean_and_rejects_bad(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found, _ = importance.resample(docs, labels)
    known = found.join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {(r.quality, r.toxic): r.share for r in known.collect()}
    assert share[1, 0] > 0.95 and share[0, 0] == 0 and share[0, 1] == 0 and share[1, 1] < 0.35
    kept = importance.resampled(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in found.where("kept").select("doc_id").collect()}


def test_importance_of_odd_rows_and_of_none(odd, none, labels):
    found = importance.resample(odd, labels)[0].collect()
    assert len(found) == odd.count() and not any(r.kept for r in found if r.doc_id in (3, 4, 5))
    again = importance.resample(odd, labels)[0].collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert importance.resampled(odd, labels).columns == odd.columns
    assert importance.resampled(odd, labels.limit(0)).count() == odd.count() - 4
    assert importance.resample(none, labels)[0].count() == 0 and importance.resampled(none, labels).count() == 0


def test_fit_settles_also_where_nearly_all_is_told_apart():
    rng = np.random.default_rng(8)
    good = rng.random(6000) < 0.75
    rows = np.stack(
        [np.where(good, 0, -rng.exponential(0.3, 6000)), np.where(good, -rng.exponential(1, 6000), -30), rng.normal(5, 1, 6000)], 1
    )
    rows[:20, 0], rows[:20, 1] = -9, -1
    weight = importance.fitted(rows, good.astype(float))(rows)
    assert ((weight > 0) == good).mean() > 0.99
    assert abs((1 / (1 + np.exp(-weight))).sum() - good.sum()) < 5


def test_kth_largest(spark):
    rng = random.Random(9)
    values = [rng.choice([0.0, 1.5, rng.gauss(0, 1), 1e9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 500, 1500, 2999, 3000):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_text_dimensions_keep_apart_values_that_begin_alike(spark):
    docs = [(k, "x", f"https://www.host{k % 7}.org/", "en", 1) for k in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
    rows = hilbert.placed(df, dimensions=("source",), carry=("source",)).collect()
    codes = {}
    for r in rows:
        codes.setdefault(r.curve, set()).add(r.source)
    assert len(codes) == 7 and all(len(v) == 1 for v in codes.values())
    assert [sorted(v)[0] for _, v in sorted(codes.items())] == sorted({d[2] for d in docs})
    many = spark.createDataFrame([(f"lead {k:05d}",) for k in range(6000)] + [(None,)], "d0 string")
    bounds = hilbert.text_bounds(many, "d0", 254)
    parts = hilbert.coded(many.toPandas()["d0"], bounds)
    assert parts[-1] == 0 and (np.diff(parts[:-1]) >= 0).all() and np.bincount(parts[:-1])[1:].max() < 120


def test_text_bounds_count_every_value(spark):
    rng = random.Random(4)
    rows = [f"v{rng.randrange(9000):05d}" for _ in range(9000)] + ["v04000"] * 3000 + ["v00007"] * 500
    df = spark.createDataFrame([(v,) for v in rows] + [(None,)], "d0 string")
    values, n = np.unique(rows, return_counts=True)
    sums = np.cumsum(n)
    for count in (3, 254):
        at = np.unique(np.searchsorted(sums * (count + 1), len(rows) * np.arange(1, count + 1)))
        assert hilbert.text_bounds(df, "d0", count) == [str(v) for v in values[at]]
    assert hilbert.text_bounds(df.limit(0), "d0", 3) == []


def test_brackets_are_read_once():
    import time

    begun = time.perf_counter()
    text = "see http://[" + ":" * 400_000 + " and ssh://[::1.2.3.4] or http://[fe80::1]/ or x://[1.2:3]"
    assert [text[a:b] for kind, a, b in private.find(text) if kind == "ip6"] == ["[::1.2.3.4]", "[fe80::1]"]
    assert time.perf_counter() - begun < 5


@pytest.mark.parametrize("name", ["op5_line_frequency", "op6_benchmark_windows"])
def test_sql_gives_the_same(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = QUERIES[name](spark, folder)
    rows = con.sql(f"SELECT {', '.join(found.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in found.collect())
