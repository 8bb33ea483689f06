"""Whole texts to token ids with the tokenizers library, a part at a time.

No vocabulary here merges across the places where texts are cut, so the ids of the parts in a row are
the ids of the text. Parts are found in the bytes of all texts of a batch at once; each different part
is encoded by the library once and its ids are looked up after, by its bytes, in a flat table. The
table is bounded; parts met once it is full are encoded again in each batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa

from sessionlake.llm.words import mix, raw_bytes

#: Parts that a worker remembers, and places for them.
MOST_PARTS, PLACES = 1_000_000, 1 << 21
#: Bytes of the longest part that is remembered, in words of eight.
WIDTH = 3

#: Its string in a text stands for itself, and texts on either side of it are encoded apart.
MARK = "<|endoftext|>"

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: A run of symbols that begins with one of these is never of one piece with the letter before it.
AFTER = np.zeros(256, bool)
AFTER[list(b',.;:!?()"')] = True
#: First bytes of white space outside ASCII.
LEADS = np.zeros(256, bool)
LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
ODD_SPACES = [
    c.encode() for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
]
_ODD2 = np.array([int.from_bytes(b, "big") for b in ODD_SPACES if len(b) == 2])
_ODD3 = np.array([int.from_bytes(b, "big") for b in ODD_SPACES if len(b) == 3])

_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _white(raw: np.ndarray) -> np.ndarray:
    """Which bytes are of white space, outside ASCII too."""
    white = SPACE[raw]
    at = np.flatnonzero(LEADS[raw])
    if at.size:
        padded = np.concatenate([raw, np.zeros(2, np.uint8)]).astype(np.int64)
        two = (padded[at] << 8) | padded[at + 1]
        here = at[np.isin(two, _ODD2)]
        white[here] = white[here + 1] = True
        here = at[np.isin((two << 8) | padded[at + 2], _ODD3)]
        white[here] = white[here + 1] = white[here + 2] = True
    return white


def _marks(raw: np.ndarray) -> np.ndarray:
    """Symbols just behind a letter begin a part."""
    cut = np.zeros(len(raw), bool)
    cut[1:] = LETTER[raw[:-1]] & AFTER[raw[1:]]
    return cut


def cut_with_space(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each part for vocabularies whose words begin with the blank before them: of a
    run of white space before a word, the last blank goes with the word, any other last character is
    a part, and so is all before it."""
    white = _white(raw)
    cut = _marks(raw)
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[begins] = True
    first = white.copy()
    first[1:] &= ~white[:-1]
    cut |= first
    solid = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[begins] = True
    solid = solid[~fresh[solid]]
    last = raw[solid - 1]
    blank = last == 0x20
    cut[solid[blank] - 1] = True
    cut[solid[~blank]] = True
    cut[solid[~blank & (last < 0x80)] - 1] = True
    wide = solid[last >= 0x80]
    cut[np.where(raw[wide - 2] == 0xC2, wide - 2, wide - 3)] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(raw))


def cut_without_space(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each part for vocabularies that drop white space: cut at blanks and line feeds."""
    inside = (raw != 0x20) & (raw != 0x0A)
    cut = _marks(raw)
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    cut[1:] |= ~inside[:-1]
    cut &= inside
    starts = np.flatnonzero(cut)
    # A part ends at the next begin, blank or text; only those of solid bytes are looked at.
    edges = np.flatnonzero(np.append(cut | ~inside, True))
    return starts, edges[np.searchsorted(edges, starts, side="right")]


class Table:
    """Numbers of short parts by their bytes: open addressing in flat arrays, all parts at once."""

    def __init__(self, places: int = PLACES) -> None:
        self.mask = np.uint64(places - 1)
        self.words = np.zeros((WIDTH, places), np.uint64)
        self.sizes = np.zeros(places, np.uint8)
        self.numbers = np.zeros(places, np.int32)

    @staticmethod
    def _home(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = sizes.astype(np.uint64)
        for k in range(WIDTH):
            h = (h ^ words[k]) * _SALTS[k]
            h ^= h >> np.uint64(29)
        return mix(h)

    def find(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each part, -1 where it is not held."""
        place = self._home(words, sizes) & self.mask
        out = np.full(len(sizes), -1, np.int64)
        left = np.arange(len(sizes))
        while left.size:
            at = place[left]
            held = self.sizes[at]
            same = held == sizes[left]
            for k in range(WIDTH):
                same &= self.words[k][at] == words[k][left]
            out[left[same]] = self.numbers[at[same]]
            left = left[~same & (held != 0)]
            place[left] = (place[left] + np.uint64(1)) & self.mask
        return out

    def add(self, words: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> None:
        """Takes up parts, all different and none held yet."""
        place = self._home(words, sizes) & self.mask
        left = np.arange(len(sizes))
        while left.size:
            at, own = np.unique(place[left], return_index=True)
            own = own[self.sizes[at] == 0]
            mine = left[own]
            self.sizes[place[mine]], self.numbers[place[mine]] = sizes[mine], numbers[mine]
            for k in range(WIDTH):
                self.words[k][place[mine]] = words[k][mine]
            left = np.delete(left, own)
            taken = self.sizes[place[left]] != 0
            place[left[taken]] = (place[left[taken]] + np.uint64(1)) & self.mask


def _load(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of short parts as words of eight, zeros behind."""
    padded = np.concatenate([raw, np.zeros(8 * WIDTH, np.uint8)])
    eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    out = np.empty((WIDTH, len(begins)), np.uint64)
    for k in range(WIDTH):
        out[k] = eights[begins + 8 * k] & _LOW[np.clip(sizes - 8 * k, 0, 8)]
    return out


class Encoder:
    """`cut` finds the parts; `tokenizer` encodes texts between marks, `literal` texts that hold the
    string of a mark."""

    def __init__(self, tokenizer: Any, literal: Any, cut: Callable) -> None:
        self.tokenizer, self.literal, self.cut = tokenizer, literal, cut
        self.mark = tokenizer.token_to_id(MARK)
        self.table = Table()
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each of `words`; many are given to the library as one text between marks."""
        own = [w for w in words if "<|" not in w]
        texts = [MARK.join(own[k : k + 200]) for k in range(0, len(own), 200)]
        plain: list[np.ndarray] = []
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(found.ids, np.uint32)
            low = 0
            for end in [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]:
                plain.append(ids[low:end])
                low = end + 1
        rest = iter(plain)
        return [
            np.array(self.literal.encode(w, add_special_tokens=False).ids, np.uint32) if "<|" in w else next(rest)
            for w in words
        ]

    def _numbered(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
        """The number of each part, after its ids have been found, and how many numbers to forget after."""
        sizes = ends - begins
        number = np.full(len(begins), -1, np.int64)
        short = np.flatnonzero(sizes <= 8 * WIDTH)
        words = _load(raw, begins[short], sizes[short])
        number[short] = self.table.find(words, sizes[short])
        held = len(self.lengths)
        unknown = np.flatnonzero(number[short] < 0)
        keys = np.empty((len(unknown), WIDTH + 1), np.uint64)
        keys[:, :WIDTH], keys[:, WIDTH] = words[:, unknown].T, sizes[short[unknown]]
        _, first, which = np.unique(
            keys.view(f"V{8 * (WIDTH + 1)}").ravel(), return_index=True, return_inverse=True
        )
        number[short[unknown]] = held + which
        new = short[unknown[first]]
        texts = [raw[b:e].tobytes().decode(errors="replace") for b, e in zip(begins[new], ends[new], strict=True)]
        longer: dict[bytes, int] = {}
        for k in np.flatnonzero(sizes > 8 * WIDTH):
            part = raw[begins[k] : ends[k]].tobytes()
            number[k] = held + longer.setdefault(part, len(texts))
            if number[k] == held + len(texts):
                texts.append(part.decode(errors="replace"))
        if not texts:
            return number, 0
        ids = self._encoded(texts)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, *ids])
        kept = max(0, min(len(first), MOST_PARTS - held))
        own = unknown[first[:kept]]
        self.table.add(
            words[:, own], sizes[short[own]].astype(np.uint8), np.arange(held, held + kept, dtype=np.int32)
        )
        return number, len(texts) - kept

    def _forget(self, count: int) -> None:
        if count:
            self.starts, self.lengths = self.starts[:-count], self.lengths[:-count]
            self.flat = self.flat[: int(self.starts[-1] + self.lengths[-1]) if len(self.starts) else 0]

    def encode(self, texts: pa.Array | Sequence[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, `end` after each, and how many each text has. No nulls."""
        raw, offsets = raw_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        if not len(raw):
            ids, counts = np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        else:
            begins, ends = self.cut(raw, offsets)
            part, past = self._numbered(raw, begins, ends)
            lengths = self.lengths[part]
            before = np.cumsum(lengths) - lengths
            ids = self.flat[np.repeat(self.starts[part] - before, lengths) + np.arange(int(lengths.sum()))]
            self._forget(past)
            sums = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(begins, offsets)]
            counts = np.diff(sums)
        if end is None:
            return ids, counts
        return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1


def _from_file(path: str, plain: bool) -> Any:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    return tokenizer


@cache
def encoder(path: str, keeps_space: bool, plain: bool = False) -> Encoder:
    """One for each vocabulary in a worker, kept from task to task. `keeps_space`: a byte-level
    vocabulary, whose words begin with the blank before them; else one that drops white space and
    case. `plain`: the strings of special tokens are ordinary text."""
    cut = cut_with_space if keeps_space else cut_without_space
    return Encoder(_from_file(path, False), _from_file(path, plain), cut)
