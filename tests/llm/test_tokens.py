from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sessionlake.llm import addressable, packing, separators
from sessionlake.llm.tokens import encoder, vocabulary
from sessionlake.llm.words import runs, word_hashes

TEXTS = [
    "", "  two  spaces\n\n x\ty <|endoftext|>z a b \x1c c", "é é it's 12 345\n", "\n x ", " ", "a\0b c",
    "(ab) a(b) 'x' don't *a* x<|endoftext|> ÉÀ Σας ΣΑΣ, İstanbul ( [ ]. ab.c_ éx ,é, é x",
    "q" * 500, " <|startoftext|>a, <|", "tab\tand\xa0blank", "word-word, (word) word's WORD",
]


@pytest.mark.parametrize("name, keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("plain", [False, True])
def test_words_give_the_ids_of_the_text(name, keeps, plain, texts, monkeypatch):
    monkeypatch.setattr("sessionlake.llm.tokens.MOST_PARTS", 500)
    tool = encoder.__wrapped__(vocabulary(name), keeps, plain)
    rng = random.Random(1)
    made = ["".join(rng.choice("aB .,'\n\té1<|\xa0\x85\u2003\u3000\u0301—((?Σ") for _ in range(40)) for _ in range(900)]
    every = TEXTS + made + [t for _, t in texts[:60]]
    ids, counts = [], []
    for low in range(0, len(every), 50):
        got, n = tool.encode(every[low : low + 50], 7)
        ids.append(got), counts.append(n)
    got = np.split(np.concatenate(ids), np.cumsum(np.concatenate(counts)))[:-1]
    want = [[*e.ids, 7] for e in tool.literal.encode_batch(every, add_special_tokens=False)]
    assert [list(g) for g in got] == want


def test_word_hashes_and_runs(texts, monkeypatch):
    monkeypatch.setattr("sessionlake.llm.words.PIECE", 1000)
    every = ["", " ", "One oNE\x0btwo", "é\x85é a\xa0b", "x" * 5000 + " y"] + [t for _, t in texts]
    hashes, counts = word_hashes(pa.array(["no"] + every).slice(1))
    words = [t.encode().split() for t in every]
    assert list(counts) == [len(w) for w in words]
    by = {}
    flat = [w.lower() for ws in words for w in ws]
    assert all(by.setdefault(w, h) == h for w, h in zip(flat, hashes, strict=True))
    assert len(set(by.values())) == len(by)
    found, made = runs(hashes, counts, 5)
    tuples = [
        tuple(w.lower() for w in ws[k : k + 5]) for ws in words for k in range(max(1, len(ws) - 4) if ws else 0)
    ]
    assert made.sum() == len(tuples)
    by = {}
    assert all(by.setdefault(t, h) == h for t, h in zip(tuples, found, strict=True))
    assert len(set(by.values())) == len(by)


def ids_of(texts, name, end):
    tool = encoder(vocabulary(name), "byte" in name).tokenizer
    every = tool.encode_batch([t or "" for _, t in texts], add_special_tokens=False)
    return {i: np.array([*e.ids, end], "<u4") for (i, _), e in zip(texts, every, strict=True)}


def laid_out(rows, limit=4096):
    """Every sequence is filled from 0 without a gap or overflow; returns how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_packing_holds_every_piece_once(documents, texts):
    rows = packing.pack(documents).collect()
    want = ids_of(texts, "word_bpe_49k.json", 1)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == want.keys()
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == [4096 * k for k in range(len(pieces))]
        assert sum(r.length for r in pieces) == len(want[i])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(want[i][r.start : r.start + r.length].tobytes())
    assert laid_out(rows) <= -(-sum(map(len, want.values())) // 4096) + 1


def test_breeding_beats_its_parents_and_keeps_every_item():
    rng = np.random.default_rng(3)
    sizes = rng.integers(900, 2300, 400)
    breeding = packing.Breeding(population=6, generations=30)
    first = packing.evolve(sizes, [], 4096, packing.Breeding(generations=0), np.random.default_rng(0))
    last = packing.evolve(sizes, list(first), 4096, breeding, np.random.default_rng(0))
    for bins in last:
        assert len(bins) == 400 and np.bincount(bins, sizes).max() <= 4096
    assert packing.worth(sizes, last[0], 4096) >= packing.worth(sizes, first[0], 4096)


def test_packing_of_odd_rows_and_of_none(odd, none):
    small = packing.Breeding(block=4)
    rows = packing.pack(odd, breeding=small).collect()
    laid_out(rows)
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert sum(r.start == 0 and r.length == 1 for r in rows) == 4
    assert packing.pack(none).collect() == []


def test_codes_give_any_id():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 1 << 32, 3000), rng.integers(0, 50_000, 5000), np.array([7]), rng.integers(0, 200, 600)):
        ids = ids.astype(np.uint32)
        codes = addressable.Codes(addressable.to_codes(ids))
        assert (codes.all() == ids).all()
        assert all(codes[k] == ids[k] for k in range(0, len(ids), 7))
    with pytest.raises(IndexError):
        codes[len(codes.all())]


def test_files_of_codes_round_trip(documents, texts, monkeypatch):
    rows = sorted(addressable.read_codes(addressable.write_codes(documents)).collect(), key=lambda r: r.doc_id)
    want, at = ids_of(texts, "byte_bpe_50k.json", 2), 0
    for r in rows:
        own = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert len(rows) == len(want)


def test_codes_of_odd_rows_and_of_none(odd, none):
    rows = sorted(addressable.read_codes(addressable.write_codes(odd)).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    ids = [r.doc_id for r in rows]
    assert ids == [None] * 3 + sorted(i for i in ids if i is not None) and len(ids) == odd.count()
    assert addressable.read_codes(addressable.write_codes(none)).collect() == []


def test_separator_scan_counts_whole_documents(documents, texts, odd, none):
    tool = encoder(vocabulary("byte_bpe_50k.json"), True, True).literal
    want = {i: len(tool.encode(t).ids) + 1 for i, t in texts}
    files = separators.write_flat(documents.repartition(3), block=1000)
    rows = separators.counts(files).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want)
    assert files.where("data is not null").agg({"block": "max"}).first()[0] > 3
    assert separators.counts(separators.write_flat(odd, block=64)).count() == odd.count()
    assert separators.counts(separators.write_flat(none)).count() == 0


def test_separator_scan_stitches_blocks(spark):
    ids = [5, 9, 1, 2, 3, 4, 5, 6, 9, 9, 7]  # ends at 9; the last document has no end
    blocks = [(0, k, bytes(np.array(ids[2 * k : 2 * k + 2], "<u2").tobytes())) for k in range(6)]
    files = spark.createDataFrame(blocks, "file long, block long, data binary")
    rows = sorted(separators.scan(files, end=9).collect())
    assert [tuple(r) for r in rows] == [(0, 0, 0, 2), (0, 1, 2, 7), (0, 2, 9, 1), (0, 3, 10, 1)]
