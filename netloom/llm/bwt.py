"""Repeated strings of a byte sequence by its Burrows-Wheeler transform.

Suffixes are ordered as far as the least length goes. Intervals of the transform are then extended backwards, breadth first: from the interval
of a string of length n, those of the strings one byte longer. The row after such an interval shares n bytes with the row before it, if no
shorter length was found there earlier; so common prefixes come by increasing value, and the walk ends at the least length: rows
that no step has reached share that many bytes or more.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the first key of a suffix holds; shorter common prefixes are read from these keys.
HEAD = 8


def _ranked(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the keys, equal ones alike; ``order`` sorts them."""
    placed = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = placed[1:] != placed[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def _heads(data: np.ndarray) -> np.ndarray:
    """The first ``HEAD`` bytes of every suffix as a big-endian number; zeros after the end."""
    wide = np.concatenate([data, np.zeros(HEAD, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for k in range(HEAD):
        key = (key << np.uint64(8)) | wide[k : k + len(data)]
    return key


def suffix_order(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``least`` bytes, and their heads. Prefix doubling; suffixes that stand alone are done."""
    n = len(data)
    heads = _heads(data)
    order = np.argsort(heads, kind="stable")
    rank = _ranked(order, heads)
    depth = HEAD
    while depth < least:
        step = min(depth, least - depth)
        at = rank[order]
        alone = np.ones(n, bool)
        alone[1:] &= at[1:] != at[:-1]
        alone[:-1] &= at[:-1] != at[1:]
        rows = np.flatnonzero(~alone)
        if not len(rows):
            break
        # rows of equal rank stand together; a rank counts places, so that a later one never meets it
        of = order[rows]
        behind = of + step
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        first = at[rows]
        sort = np.argsort(first * np.int64(n + 1) + second, kind="stable")
        order[rows] = of[sort]
        new = np.ones(n, bool)
        new[1:] = at[1:] != at[:-1]
        split = np.zeros(n, bool)
        second = second[sort]
        split[rows[1:]] = second[1:] != second[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new | split) - 1
        depth += step
    return order, heads


def common_prefixes(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and, for each, the bytes that it shares with the one before it; ``least`` stands for as many or more."""
    n = len(data)
    order, heads = suffix_order(data, least)
    row_of = np.empty(n, np.int64)
    row_of[order] = np.arange(n)
    shared = np.full(n + 1, least, np.int64)
    shared[0] = shared[n] = 0
    placed = heads[order]
    differ = placed[1:] ^ placed[:-1]
    short = np.flatnonzero(differ) + 1
    shared[short] = np.minimum(7 - (np.log2(differ[short - 1].astype(np.float64)).astype(np.int64) >> 3), HEAD - 1)
    # a difference just below a power of two is rounded up to it
    over = (differ[short - 1] >> (np.uint64(8) * (7 - shared[short]).astype(np.uint64))) == 0
    shared[short[over]] += 1
    if least <= HEAD:
        return order, np.minimum(shared[:n], least)
    # a row's suffix with the byte before it has row ``back``; the rows before and after that one, without their first byte, are
    # ``behind`` and ``ahead`` if that byte is the same
    back = row_of[order - 1]
    real = order > 0
    rest = np.append(row_of, n)[order + 1]
    byte = data[order]
    same = byte[1:] == byte[:-1]
    after, before = np.full(n, n), np.full(n, -1)
    after[:-1] = np.where(same, rest[1:], n)
    before[1:] = np.where(same & (rest[:-1] < n), rest[:-1], -1)
    ahead, behind = after[back], before[back]
    edges = np.flatnonzero(shared < HEAD)
    low, high = edges[:-1], edges[1:]
    for length in range(HEAD, least):
        if not len(low):
            break
        size = high - low
        start = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        rows = start + np.arange(int(size.sum()))
        first, end = np.repeat(low, size), np.repeat(high, size)
        opens = np.sort(back[rows[real[rows] & (behind[rows] < first)]])
        closes = np.sort(back[rows[real[rows] & (ahead[rows] >= end)]]) + 1
        new = shared[closes] == least
        low, high = opens[new], closes[new]
        shared[high] = length
    return order, shared[:n]


def repeated_starts(data: np.ndarray, valid: np.ndarray, least: int) -> np.ndarray:
    """Which positions begin a string of ``least`` bytes that begins at another valid position too; invalid ones are never counted.

    Strings of valid positions must not equal those of invalid ones, as where a separator lies within those."""
    if len(data) < 2:
        return np.zeros(len(data), bool)
    order, shared = common_prefixes(data, least)
    alike = shared >= least
    alike[:-1] |= alike[1:].copy()
    out = np.zeros(len(data), bool)
    out[order] = alike
    return out & valid
