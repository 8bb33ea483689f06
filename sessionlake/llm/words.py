"""Hashes of all words of a batch of texts at once, from the bytes as Arrow holds them."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a cut falls between words.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(_BASE)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_R = np.random.default_rng(20_240_229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = _R.copy()
FOLDED[65:91] = _R[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        out = np.full(n, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(_BASE), row(pow(_BASE, -1, 1 << 64))


def raw_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, as Arrow holds them, and where each begins and the last ends."""
    values = values.cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (a run without white space, A-Z as a-z) of all texts in a row, and
    the number of words in each text. No nulls."""
    raw, offsets = raw_bytes(values)
    firsts = np.zeros(len(raw) + 1, bool)
    firsts[offsets] = True
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw):
            gaps = np.flatnonzero(SPACE[raw[end : end + 4096]])
            if gaps.size:
                end += int(gaps[0])
                break
            end = min(end + 4096, len(raw))
        piece = raw[at:end]
        inside = ~SPACE[piece]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        begins = np.flatnonzero(inside & (~before | firsts[at:end]))
        if begins.size:
            after = np.empty_like(inside)
            after[-1], after[:-1] = False, inside[1:]
            stops = np.flatnonzero(inside & (~after | firsts[at + 1 : end + 1])) + 1
            size = 1 << max(20, (len(piece) - 1).bit_length())
            power, back = _powers(size)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(FOLDED[piece] * power[: len(piece)], out=sums[1:])
            hashes.append(mix((sums[stops] - sums[begins]) * back[begins]))
            starts.append(begins + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(values), np.int64)
    where = np.concatenate(starts)
    counts = np.diff(np.searchsorted(where, offsets))
    return np.concatenate(hashes), counts


def runs(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of `n` words that lies in one text, and the runs in each text. A text of
    fewer words, but not none, is one run."""
    ends = np.cumsum(counts)
    begins = ends - counts
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    total = int(made.sum())
    at = np.repeat(begins - (np.cumsum(made) - made), made) + np.arange(total)
    limit = np.repeat(ends, made)
    h = np.full(total, np.uint64(n))
    for k in range(n):
        word = at + k
        inside = word < limit
        h = h * _ODD + np.where(inside, hashes[np.minimum(word, max(len(hashes) - 1, 0))], np.uint64(0))
    return mix(h), made
