"""Dense per-text measures shared by the classifiers, computed for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

from . import _text

_PUNCT = np.zeros(256, bool)
_PUNCT[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True
_KEPT_BYTES = [*b"!?#$%&*<>|@,.\n"]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each of the ranges that the n+1 offsets ``first`` bound."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def byte_rates(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shares of letters, capitals, digits, punctuation, bytes over 127 and single marks."""
    counts = _text.byte_counts(data, at).astype(np.float64)
    size = np.maximum(counts.sum(axis=1), 1.0)[:, None]
    groups = np.stack([counts[:, LETTER].sum(1), counts[:, _UPPER].sum(1), counts[:, _DIGIT].sum(1), counts[:, _PUNCT].sum(1), counts[:, 128:].sum(1)], axis=1)
    return np.hstack([groups, counts[:, _KEPT_BYTES]]) / size


def letter_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of letters within a text, and n+1 offsets of each text's runs."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    letter = LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1] | cut[1:-1]
    end[:-1] &= ~letter[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def repeat_rates(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the share of its hashes that equal an earlier one of it."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o, again, minlength=len(first) - 1) / np.maximum(np.diff(first), 1)


def windows(word_hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words that lie within one text, and n+1 offsets."""
    n = np.diff(first)
    counts = np.maximum(n - size + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if not offsets[-1]:
        return np.empty(0, np.uint64), offsets
    places = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts) + np.repeat(first[:-1], counts)
    total = np.zeros(len(places), np.uint64)
    for k in range(size):
        total += word_hashes[places + k] * np.uint64(2 * k * k + 6 * k + 3)
    return _text.mix(total), offsets
