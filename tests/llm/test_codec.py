from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from sessionlake.llm import codec
from sessionlake.llm.queries import op12_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", " ", "a", "\n\n x", "it's we'll I'M 'tis ''s", "  two\t\ttabs \n", "aaaaaaaaaaaaaaaaaaaaaa", "======-----====",
    "日本語のテキスト、漢字。", "Привет, мир", "👩‍👩‍👧‍👦 🇩🇪 é", "a\xa0b  c　", "x" * 40_000, " " * 3000 + "y",
    "<|endoftext|> <|x|>", "\0\1\x1c\x85", "१२३ ٣٤ 12345",
]


def plain(path=PATH, pattern=public_tokenizers.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.read_ranks(path), special_tokens={})


def made(n, seed=3):
    rng = random.Random(seed)
    signs = "aaabB  .,'\n\té1日本пр́\xa0 👍=-<|st"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_ids_and_spans_are_those_of_the_other_library(name, texts):
    path = public_tokenizers.path(name)
    tool, other = codec.Codec(path, public_tokenizers.PATTERN), plain(path)
    every = ODD + made(3000) + [t or "" for _, t in texts]
    for low in range(0, len(every), 400):
        some = every[low : low + 400]
        ids, counts, starts, ends = tool.encode(pa.array(some))
        assert ids.dtype == np.uint32
        at = 0
        for text, n in zip(some, counts.tolist(), strict=True):
            want = other.encode_ordinary(text)
            assert ids[at : at + n].tolist() == want
            spans = list(zip(starts[at : at + n].tolist(), ends[at : at + n].tolist(), strict=True))
            if len(text) < 200:
                assert spans == tool.tokenizer.encode(text, add_special_tokens=False).offsets
            assert "".join(tool.token_texts(text, *zip(*spans, strict=True)) if spans else "") == text
            at += n


def test_merges_hold_on_tight_alphabets():
    """Tokens of few letters meet in every order; ties go to the left."""
    tool, other = codec.Codec(PATH, public_tokenizers.PATTERN), plain()
    rng = random.Random(9)
    for signs in ("ab", "a", "-=", "aA ", "é", "ing", "01", "日本人", " \n"):
        some = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(300)]
        ids, counts, _, _ = tool.encode(pa.array(some))
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [other.encode_ordinary(t) for t in some]


def test_query_against_the_other_library(spark, folder, texts):
    other, rows = plain(), op12_byte_bpe(spark, folder).collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    assert len(rows) == len(texts) == len(got)
    for doc_id, text in texts:
        ids = other.encode_ordinary(text or "")
        want = hashlib.sha256(np.array(ids, "<u4").tobytes()), hashlib.sha256(other.decode_bytes(ids))
        assert got[doc_id] == (len(ids), want[0].hexdigest(), want[1].hexdigest())


def test_round_trip_of_odd_rows_and_of_none(odd, none, monkeypatch):
    monkeypatch.setattr("sessionlake.llm.codec.SLICE_IDS", 100)
    rows = codec.decoded(codec.encoded(odd)).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in rows)
    assert all(bytes(r.data).decode() == r.text for r in rows)
    assert sum(r.ids == [] for r in rows) == 3
    assert codec.digests(codec.decoded(codec.encoded(none))).collect() == []


def test_split_characters(spark):
    tool = codec.codec(PATH, public_tokenizers.PATTERN)
    ids = tool.encode(pa.array(["👩‍👧x"]))[0].tolist()
    cut = next(k for k in range(1, len(ids)) if "�" in bytes(tool.bytes_of(np.array(ids[:k]))[0]).decode(errors="replace"))
    codes = spark.createDataFrame([(1, ids[:cut]), (2, ids[cut:]), (3, None), (4, [])], "doc_id int, ids array<int>")
    rows = {r.doc_id: r for r in codec.decoded(codes).collect()}
    assert bytes(rows[1].data) + bytes(rows[2].data) == "👩‍👧x".encode()
    assert "�" in rows[1].text and rows[2].text.endswith("x")
    assert rows[3].text == rows[4].text == ""
    with pytest.raises(ValueError):
        tool.bytes_of(np.array([60_000]))
    with pytest.raises(ValueError):
        codec.decoded(codes.withColumn("text", codes.doc_id))
