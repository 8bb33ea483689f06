"""Byte-level BPE both ways, with the tokenizers library over Arrow batches.

A vocabulary of ranks (base64 of a token's bytes and its number on each line) becomes a tokenizer of
the library: every byte has a printable character that stands for it, a token is the characters of its
bytes, and the merge that makes a token is the one pair that is left of its bytes when only merges of
lower rank are done. No other pair can ever make it: merges inside its bytes go in the same order there
as anywhere. A piece that is itself a token is taken whole. Pieces are the matches of `pattern`.

`encoded` gives per document its `ids` and, for each, the code points `starts` (inclusive) and `ends`
(exclusive) of the characters that its bytes are of; a character whose bytes are several tokens' is in
each of their spans. `decoded` adds `data`, the bytes of the ids, and `text`, those bytes as UTF-8; bytes
that are no character (ids that begin or end inside one) are U+FFFD there. `token_texts` gives each
character to the first token that has a byte of it.

Nulls and empty texts have no ids and decode to nothing. Repeated rows are coded each for itself, ids
of documents may repeat or be null, only `doc_id` and `text` are read, and an empty table gives no rows.
Texts may be of any length; what a task holds is about a megabyte of text or one text. Null ids decode
as none; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import id_and_text, slices
from sessionlake.llm.tokens import MARK, Encoder, cut_with_space, vocabulary
from sessionlake.llm.words import raw_bytes

#: Ids, and their spans, in a slice of decoding.
SLICE_IDS = 1 << 18


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The pair that merges into `token`, if merges of lower rank leave a pair."""
    parts = [token[k : k + 1] for k in range(len(token))]
    limit = ranks[token]
    while len(parts) > 2:
        found = [ranks.get(a + b, limit) for a, b in zip(parts, parts[1:], strict=False)]
        least = min(found)
        if least >= limit:
            return None
        at = found.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1])


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

        ranks, shown = read_ranks(path), byte_characters()
        name = {token: "".join(shown[b] for b in token) for token in ranks}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no token of its own")
        merges = []
        for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
            pair = last_merge(token, ranks)
            if pair:
                merges.append((name[pair[0]], name[pair[1]]))
        vocab = {name[token]: rank for token, rank in ranks.items()}

        def made() -> Any:
            tool = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
            tool.pre_tokenizer = pre_tokenizers.Sequence(
                [
                    pre_tokenizers.Split(Regex(pattern), "isolated"),
                    pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
                ]
            )
            tool.decoder = decoders.ByteLevel()
            return tool

        self.tokenizer, marked = made(), made()
        marked.add_special_tokens([MARK])
        self.parts = Encoder(marked, self.tokenizer, cut_with_space)
        size = max(ranks.values()) + 1
        token_of = dict(zip(ranks.values(), ranks, strict=True))
        self.sizes = np.array([len(token_of.get(k, b"")) for k in range(size)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(token_of.get(k, b"") for k in range(size)), np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, how many each has, and the code points in its text that each id
        begins and ends with."""
        ids, counts = self.parts.encode(texts, None)
        raw, offsets = raw_bytes(texts)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if int(sizes.sum()) != len(raw):
            raise ValueError("the ids do not cover the texts")
        lead = (raw & 0xC0) != 0x80
        character = np.concatenate([np.cumsum(lead), [int(lead.sum()) + 1]])  # from 1, of each byte
        base = np.repeat(np.concatenate([[0], character])[offsets[:-1]], counts)
        return ids, counts, character[ends - sizes] - 1 - base, character[ends - 1] - base

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and how many each id has."""
        if ids.size and not (0 <= int(ids.min()) and int(ids.max()) < len(self.sizes)):
            raise ValueError("an id outside the vocabulary")
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[ids] - before, sizes) + np.arange(int(sizes.sum()))], sizes

    @staticmethod
    def token_texts(text: str, starts: Sequence[int], ends: Sequence[int]) -> list[str]:
        """The characters of each token; one that is split goes to the first that has a byte of it."""
        told, out = 0, []
        for a, b in zip(starts, ends, strict=True):
            out.append(text[max(a, told) : b])
            told = max(told, b)
        return out


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each vocabulary in a worker, kept from task to task."""
    return Codec(path, pattern)


def _places(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or vocabulary("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends."""
    path, pattern = _places(path, pattern)
    docs = id_and_text(docs)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(name, ints) for name in ("ids", "starts", "ends")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in slices(batches):
            ids, counts, *spans = tool.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[_lists(v, counts) for v in (ids, *spans)]], schema.names
            )

    return docs.mapInArrow(run, schema)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows in a row, and how many each row has."""
    column = column.fill_null([]) if column.null_count else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.cumsum(_ids(batch.column("ids"))[1])
        low = 0
        while low < batch.num_rows:
            base = counts[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(counts, base + SLICE_IDS, side="right")))
            yield batch.slice(low, high - low)
            low = high


def decoded(codes: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All of `codes` and `data` and `text` of its `ids`."""
    path, pattern = _places(path, pattern)
    if {"data", "text"} & {c.lower() for c in codes.columns}:
        raise ValueError("`codes` has a column named data or text already")
    schema = T.StructType(
        [*codes.schema.fields, T.StructField("data", T.BinaryType()), T.StructField("text", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in _runs(batches):
            ids, counts = _ids(batch.column("ids"))
            raw, sizes = tool.bytes_of(ids)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            data = [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            texts = pa.array([d.decode(errors="replace") for d in data], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary()), texts], schema.names)

    return codes.mapInArrow(run, schema)


def digests(codes: DataFrame) -> DataFrame:
    """Per row of what `decoded` gives: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    schema = T.StructType(
        [
            T.StructField("doc_id", codes.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = _ids(batch.column("ids"))
            flat, ends = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts, pa.int64()),
                    pa.array(
                        [
                            hashlib.sha256(flat[a:b]).hexdigest()
                            for a, b in zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True)
                        ],
                        pa.string(),
                    ),
                    batch.column("decoded_sha256"),
                ],
                schema.names,
            )

    read = codes.select("doc_id", "ids", F.sha2("data", 256).alias("decoded_sha256"))
    return read.mapInArrow(run, schema)
