"""Gated recurrent language model over words: training, and log-likelihoods of whole documents.

The output is factored: a softmax over frequency classes and, within a class of frequent words, a softmax over
its words; all other words form one class whose words have smoothed unigram shares. ``side`` classes have ``side``
words each, and ``side`` follows the fourth root of the vocabulary, so the words with an output of their own follow its root.
Inputs are rows of a table that already holds each word's projection onto the gates. Training is truncated
back-propagation over windows of parallel streams; scoring carries the state across windows, so every text is scored whole.
"""

from __future__ import annotations

import math

import numpy as np

UNITS = 24
WINDOW, STREAMS = 24, 256
#: A short text is laid in fewer streams, so that there are about this many steps.
STEPS = 160
#: Outputs that are computed at once, at least.
OUTPUTS = 8192
_NEVER = np.float32(-1e4)
Weights = dict[str, np.ndarray]


def side_of(vocabulary: int) -> int:
    """Classes, and words in a class, for a vocabulary of so many words."""
    return max(8, math.ceil(0.75 * vocabulary**0.25))


def place_of_others(w: Weights) -> int:
    """The place that stands for all words without an output of their own."""
    return w["word_b"].size


def _sigmoid_in(x: np.ndarray) -> None:
    # float32 exp is vectorised and tanh isn't; where it overflows, the result is 0 as it should be
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _softmax_in(x: np.ndarray) -> None:
    """Turn rows of ``x`` into their softmax."""
    if not (x.max() < 60 and x[:, 0].min() > -60):
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    # by a product: a sum along short rows takes longer
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]


def start_weights(counts: np.ndarray, others: float, side: int, seed: int = 3) -> Weights:
    """Weights whose output is the unigram distribution, whatever the state.

    ``counts`` are those of the frequent words, most frequent first; ``others`` the smoothed count of the rest."""
    rng = np.random.default_rng(seed)
    padded = np.zeros(side * side)
    padded[: len(counts)] = counts
    groups = padded.reshape(side, side)
    classes = np.append(groups.sum(1), max(others, 1e-9))
    log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), _NEVER).astype(np.float32)
    u = UNITS
    return {
        "input": rng.normal(0, 0.3, (side * side + 1, 3 * u)).astype(np.float32),
        "state": (rng.normal(0, 1, (u, 3 * u)) / np.sqrt(u)).astype(np.float32),
        "class_w": np.zeros((u, side + 1), np.float32),
        "class_b": log(classes / classes.sum()),
        "word_w": np.zeros((side, u, side), np.float32),
        "word_b": log(groups / np.maximum(groups.sum(1, keepdims=True), 1e-300)),
    }


def _by_class(group: np.ndarray, side: int):
    """``(class, rows)`` of every class of frequent words that occurs."""
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(side + 1))
    for c in range(side):
        if cuts[c] < cuts[c + 1]:
            yield c, order[cuts[c] : cuts[c + 1]]


def _log_share(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at its chosen column; ``x`` is overwritten."""
    if not (x.max() < 60 and x[:, 0].min() > -60):
        x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), chosen]
    np.exp(x, out=x)
    own -= np.log(x @ np.ones(x.shape[1], x.dtype))
    return own


def output_log(w: Weights, h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Natural log of the share of each word's class times its share in the class (1 in the class of others)."""
    side = len(w["word_b"])
    group = word // side
    x = h @ w["class_w"]
    x += w["class_b"]
    out = _log_share(x, group)
    for c, rows in _by_class(group, side):
        x = h[rows] @ w["word_w"][c]
        x += w["word_b"][c]
        out[rows] += _log_share(x, word[rows] - c * side)
    return out


def advance(w: Weights, h: np.ndarray, word: np.ndarray) -> np.ndarray:
    u = UNITS
    x, s = w["input"][word], h @ w["state"]
    gates = x[:, : 2 * u] + s[:, : 2 * u]
    _sigmoid_in(gates)
    new = gates[:, u:] * s[:, 2 * u :]
    new += x[:, 2 * u :]
    # tanh by the sigmoid of twice the number
    new *= 2
    _sigmoid_in(new)
    new *= 2
    new -= 1
    h = h - new
    h *= gates[:, :u]
    h += new
    return h


def document_logs(w: Weights, words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The model's log (natural) of each document, others' shares in their class left out.

    ``first`` are n+1 offsets into ``words``. Documents run side by side, longest first; each window's
    outputs are computed at once and its last state is the next one's first."""
    n = len(first) - 1
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, size = first[:-1][order], sizes[order]
    words = words.astype(np.int32)
    total = np.zeros(n)
    h = np.zeros((n, UNITS), np.float32)
    longest, each = int(size[0]) if n else 0, np.arange(n)
    with np.errstate(over="ignore"):
        at = 0
        # documents that go beyond each place
        beyond = n - np.cumsum(np.bincount(size, minlength=longest + 1))
        while at < longest:
            states, taken, owner = [], [], []
            # where few documents are left, a window is longer
            end = min(at + max(window, OUTPUTS // int(beyond[at])), longest)
            for t, active in enumerate(beyond[at:end].tolist(), at):
                h = h[:active]
                word = words[begin[:active] + t]
                states.append(h)
                taken.append(word)
                owner.append(each[:active])
                h = advance(w, h, word)
            log = output_log(w, np.concatenate(states), np.concatenate(taken))
            total += np.bincount(np.concatenate(owner), log, minlength=n)
            at = end
    out = np.empty(n)
    out[order] = total
    return out


def gradients(w: Weights, h: np.ndarray, words: np.ndarray, fresh: np.ndarray, losses: bool = True) -> tuple[float, Weights, np.ndarray]:
    """Loss (0 without ``losses``) and gradients of one window of streams ``words[time, stream]``, and the state after it.

    Where ``fresh`` is true a document begins and its stream's state is set to 0 before the word.
    A negative word is padding: it has no loss and leaves no trace."""
    u, side = UNITS, len(w["word_b"])
    steps, n = words.shape
    real = words >= 0
    taken = np.where(real, words, 0)
    kind = w["state"].dtype
    # 0 where a document begins, by which the state is multiplied
    keep = (~fresh).astype(kind)[:, :, None]
    fresh_at = fresh.any(axis=1).tolist()
    x = w["input"][taken]
    before, gates, news, parts = (np.empty((steps, n, k), kind) for k in (u, 2 * u, u, u))
    for t in range(steps):
        h = np.multiply(h, keep[t], out=before[t]) if fresh_at[t] else h
        if not fresh_at[t]:
            before[t] = h
        s = h @ w["state"]
        gate, new = gates[t], news[t]
        np.add(x[t, :, : 2 * u], s[:, : 2 * u], out=gate)
        _sigmoid_in(gate)
        parts[t] = s[:, 2 * u :]
        np.multiply(gate[:, u:], parts[t], out=new)
        new += x[t, :, 2 * u :]
        # tanh by the sigmoid of twice the number
        new *= 2
        _sigmoid_in(new)
        new *= 2
        new -= 1
        h = h - new
        h *= gate[:, :u]
        h += new
    flat_h, flat_w = before.reshape(-1, u), taken.reshape(-1)
    counted = np.flatnonzero(real.reshape(-1))
    g = {k: np.empty_like(v) if k in ("class_w", "class_b", "state") else np.zeros_like(v) for k, v in w.items()}
    size = max(len(counted), 1)
    scale = kind.type(1 / size)
    group, each, loss = flat_w // side, np.arange(len(flat_w)), 0.0

    def logs(x: np.ndarray, chosen: np.ndarray) -> float:
        return float(np.log(np.maximum(x[each[: len(x)], chosen], np.finfo(kind).tiny)).sum()) if losses else 0.0

    d = flat_h @ w["class_w"]
    d += w["class_b"]
    _softmax_in(d)
    loss -= logs(d[counted] if losses else d, group[counted])
    d[each, group] -= 1
    d *= scale if len(counted) == len(group) else (scale * real.reshape(-1, 1)).astype(kind)
    g["class_w"], g["class_b"] = flat_h.T @ d, np.ones(len(d), kind) @ d
    back = d @ w["class_w"].T
    # in order of words, and so of classes
    order = counted[np.argsort(flat_w[counted].astype(np.uint16) if w["input"].shape[0] <= 1 << 16 else flat_w[counted], kind="stable")]
    word, states = flat_w[order], flat_h[order]
    place, inner = word % side, np.zeros((len(order), u), kind)
    cuts = np.searchsorted(word, np.arange(side + 1) * side).tolist()
    for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a == b:
            continue
        d = states[a:b] @ w["word_w"][c]
        d += w["word_b"][c]
        _softmax_in(d)
        loss -= logs(d, place[a:b])
        d[each[: b - a], place[a:b]] -= 1
        d *= scale
        np.matmul(states[a:b].T, d, out=g["word_w"][c])
        np.matmul(np.ones(b - a, kind), d, out=g["word_b"][c])
        np.matmul(d, w["word_w"][c].T, out=inner[a:b])
    back[order] += inner
    back = back.reshape(steps, n, u)
    # what a step's gradients are multiplied by doesn't depend on the later ones
    z, r = gates[:, :, :u], gates[:, :, u:]
    by_z = before - news
    by_z *= z
    rest = 1 - z
    by_z *= rest
    news *= news
    np.subtract(1, news, out=news)
    news *= rest
    parts *= r
    parts *= 1 - r
    after = np.zeros_like(h)
    inputs, moved = np.empty((steps, n, 3 * u), kind), np.empty((steps, n, 3 * u), kind)
    state = np.ascontiguousarray(w["state"].T)
    for t in range(steps - 1, -1, -1):
        d_in, d_s = inputs[t], moved[t]
        np.multiply(after, news[t], out=d_in[:, 2 * u :])
        np.multiply(after, by_z[t], out=d_in[:, :u])
        np.multiply(d_in[:, 2 * u :], parts[t], out=d_in[:, u : 2 * u])
        d_s[:, : 2 * u] = d_in[:, : 2 * u]
        np.multiply(d_in[:, 2 * u :], r[t], out=d_s[:, 2 * u :])
        after *= z[t]
        after += d_s @ state
        after += back[t]
        if fresh_at[t]:
            after *= keep[t]
    g["state"] = flat_h.T @ moved.reshape(-1, 3 * u)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    if len(starts):
        g["input"][word[starts]] = np.add.reduceat(inputs.reshape(-1, 3 * u)[order], starts, axis=0)
    return loss / size, g, h


def train(w: Weights, words: np.ndarray, begins: np.ndarray, rate: float = 0.01) -> Weights:
    """Adam over truncated windows of a text, ``begins`` marking where a new piece starts, laid in ``STREAMS`` streams."""
    if not len(words):
        return w
    w = {k: v.copy() for k, v in w.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    streams = min(STREAMS, max(1, len(words) // (WINDOW * STEPS)))
    windows = -(-len(words) // (streams * WINDOW))
    room = streams * windows * WINDOW
    text, fresh = np.full(room, -1), np.zeros(room, bool)
    text[: len(words)], fresh[: len(words)] = words, begins
    text, fresh = text.reshape(streams, -1).T, fresh.reshape(streams, -1).T.copy()
    fresh[0] = True
    h = np.zeros((streams, UNITS), np.float32)
    with np.errstate(over="ignore"):
        for step in range(1, windows + 1):
            rows = slice((step - 1) * WINDOW, step * WINDOW)
            _, g, h = gradients(w, h, text[rows], fresh[rows], False)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            clip = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            now = np.float32(rate * min(1.0, step / 20) * (1.0 - 0.9 * step / windows) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            for k, x in g.items():
                x *= clip
                m[k] += np.float32(0.1) * (x - m[k])
                v[k] += np.float32(0.001) * (x * x - v[k])
                w[k] -= now * m[k] / (np.sqrt(v[k]) + np.float32(1e-8))
    return w


#: Parts in which weights travel to be averaged.
PARTS = 64


def to_parts(w: Weights) -> list[np.ndarray]:
    """The weights as ``PARTS`` vectors, in order of their names."""
    return np.array_split(np.concatenate([w[k].ravel() for k in sorted(w)]), PARTS)


def from_parts(parts: list[np.ndarray], like: Weights) -> Weights:
    flat, out, at = np.concatenate(parts), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
