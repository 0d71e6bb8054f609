"""Whole-batch text kernels on the bytes of Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, as the contracts say. Words and
shingles are identified by 64-bit hashes: a word's hash is the sum of a pseudo-random value of
each (position, byte), so it depends on nothing but the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_TABLE_POSITIONS = 64
_TABLE = mix(np.arange(_TABLE_POSITIONS * 256, dtype=np.uint64))
_SHINGLE_FACTORS = mix(np.arange(1000, 1000 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its values; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, and one text at least."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and n+1 offsets of each text's words."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    space = IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    start = ~space
    end = start.copy()
    start[1:] &= space[:-1] | cut[1:-1]
    end[:-1] &= space[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans don't overlap and have a byte at least."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    position = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    taken = data[position + np.repeat(starts, lengths)].astype(np.int64)
    code = (position << 8) | taken
    if int(lengths.max()) <= _TABLE_POSITIONS:
        value = _TABLE[code]
    else:
        value = mix(code.astype(np.uint64))
    return np.add.reduceat(value, first)


def shingle_hashes(word_hashes: np.ndarray) -> np.ndarray:
    """Hashes of one text's five-word windows, in order; a shorter text is one window, none if empty."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            whole = (word_hashes * _SHINGLE_FACTORS[:n]).sum(dtype=np.uint64) + np.uint64(n)
            return mix(np.array([whole], np.uint64))
        total = word_hashes[: n - SHINGLE + 1] * _SHINGLE_FACTORS[0]
        for k in range(1, SHINGLE):
            total = total + word_hashes[k : n - SHINGLE + 1 + k] * _SHINGLE_FACTORS[k]
    return mix(total)


def shingle_sets(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Each text's set of shingles, as a sorted array of their hashes."""
    data, at = utf8(column)
    for a, b in chunks(data, at):
        part, offs = data[at[a] : at[b]], at[a : b + 1] - at[a]
        starts, ends, first = words(part, offs)
        hashed = span_hashes(part, starts, ends)
        for i in range(b - a):
            yield np.unique(shingle_hashes(hashed[first[i] : first[i + 1]]))


def byte_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each of the 256 bytes stands in each text."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    return np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)
