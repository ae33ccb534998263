"""Vectorised 64-bit hashes of all words of many texts at once.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D); in
UTF-8 no byte of a longer character looks like one, so words of code points and
words of bytes are the same.  A word's hash is a polynomial over per-byte random
constants modulo 2**64, taken from one running sum over the whole buffer, then
mixed.  Two different words collide with a chance below 2**-50.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
#: What parts words unless a caller says otherwise.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK_BYTES = 1 << 20


class _Powers:
    """Powers of the base and of its inverse, as many as the longest buffer so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, _BASE, dtype=np.uint64))))
                self.down = np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, _INVERSE, dtype=np.uint64))))


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text makes a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each text's words begin (one more entry than texts)."""
    solid = ~breaks[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, fold: bool, breaks: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and where each text's words begin; fold lower-cases A-Z."""
    offsets = offsets - offsets[0]
    starts, ends, at = word_bounds(data, offsets, breaks)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), at
    _POWERS.upto(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_FOLDED if fold else _TABLE)[data] * _POWERS.up[: len(data)], out=total[1:])
        value = (total[ends] - total[starts]) * _POWERS.down[starts]
        return mix(value + (ends - starts).astype(np.uint64)), at


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, for all positions that have n."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            h = mix(h + _U(j)) + words[j : len(words) - n + 1 + j]
        return mix(h)


def hashed_texts(column: pa.Array, fold: bool, breaks: np.ndarray = _SPACE) -> Iterator[np.ndarray]:
    """The word hashes of each text of a binary column, in row order."""
    data, offsets = buffers(column)
    for a, b in chunks(offsets):
        words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1], fold, breaks)
        for i in range(b - a):
            yield words[at[i] : at[i + 1]]


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        return np.unique(ngram_hashes(words, n)) if len(words) >= n else mix(ngram_hashes(words, len(words)) + _U(len(words)))
