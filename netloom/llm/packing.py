"""Best-fit packing by patterns and non-negative least squares.

1. Texts become token ids; each is cut into pieces of at most ``size`` tokens. A piece's length and its rank among
   the pieces of that length in its task are written down.
2. The histogram of lengths (``size`` bins, however many pieces) is packed on the driver: patterns of a few lengths
   that fill a sequence well are enumerated, their repeat counts fitted to the histogram by non-negative
   least squares and rounded down, and what remains is packed best-fit, whole groups of equal lengths at a time.
3. Every piece finds its sequence by its length and global rank; the plan has a bounded number of rows.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._store import materialize

SIZE = 2048
#: Distinct chunks that a worker remembers (about 32 bytes each); it starts anew when full.
CACHE = 1_500_000

#: White space beyond ASCII; texts with it are encoded whole, since cutting at ASCII spaces might change their ids.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F]] = True


class ChunkEncoder:
    """Token ids of whole batches: every distinct chunk (white space and the word after it) is encoded once.

    The tokenizer's pattern never joins a word with white space that follows it, so ids of chunks
    in a row are the ids of the text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Remember the ids of new chunks."""
        listed = self.encode(texts)
        size = np.fromiter(map(len, listed), np.int64, len(listed))
        total = int(size.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used + 2 * total, np.uint32)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(listed), np.uint32, total)
        first = self.used + np.cumsum(size) - size
        self.used += total
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.first, self.size = all_keys[order], np.concatenate([self.first, first])[order], np.concatenate([self.size, size])[order]

    def batch(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and n+1 offsets."""
        n = len(at) - 1
        starts, ends, first = _text.words(data, at)
        chunk_start = np.empty(len(starts), np.int64)
        chunk_start[1:] = ends[:-1]
        filled = first[1:] > first[:-1]
        chunk_start[first[:-1][filled]] = at[:-1][filled]
        # white space at a text's end, or a text of nothing else, is a chunk too
        last_end = np.where(filled, ends[np.maximum(first[1:], 1) - 1] if len(ends) else 0, at[:-1])
        tail = np.flatnonzero(last_end < at[1:])
        owner, begin, end = np.repeat(np.arange(n), np.diff(first)), chunk_start, ends
        if len(tail):
            owner, begin, end = np.concatenate([owner, tail]), np.concatenate([begin, last_end[tail]]), np.concatenate([end, at[1:][tail]])
            order = np.argsort(begin, kind="stable")
            owner, begin, end = owner[order], begin[order], end[order]
        keys, example, back = np.unique(_text.mix(_text.span_hashes(data, begin, end) + (end - begin).astype(np.uint64)), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE:
            self.forget()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self.learn(keys[new], [raw[a:b].decode("utf-8") for a, b in zip(begin[example[new]].tolist(), end[example[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
        source, each = self.first[place][back], self.size[place][back]
        total = np.concatenate([[0], np.cumsum(each)])
        out = self.flat[np.arange(total[-1]) + np.repeat(source - total[:-1], each)]
        counts = np.bincount(owner, each, minlength=n).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if _WIDE_LEAD[data].any():
            raw = data.tobytes()
            odd = {i for i in range(n) if _WIDE_SPACE.search(raw, at[i], at[i + 1])}
            if odd:
                parts = [np.array(self.encode([raw[at[i] : at[i + 1]].decode("utf-8")])[0], np.uint32) if i in odd else out[offsets[i] : offsets[i + 1]] for i in range(n)]
                out = np.concatenate(parts)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, offsets


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces; only the first may be shorter than ``size``."""
    if total <= size:
        return [(0, total)]
    head = total % size or size
    return [(0, head), *[(at, size) for at in range(head, total, size)]]


_ENCODERS: dict[str, ChunkEncoder] = {}


def _pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = ChunkEncoder(path)
        encoder = _ENCODERS[path]
        part, number = TaskContext.get().partitionId(), 0
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            data, at = _text.utf8(batch.column("text"))
            for a, b in _text.chunks(data, at):
                ids, offsets = encoder.batch(data[at[a] : at[b]], at[a : b + 1] - at[a])
                rows, piece, start, length, crc = [], [], [], [], []
                for i in range(b - a):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(own), size)):
                        rows.append(a + i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(own[s : s + n].tobytes()))
                length_of = np.array(length)
                order = np.argsort(length_of, kind="stable")
                ordered = length_of[order]
                new = np.ones(len(ordered), bool)
                new[1:] = ordered[1:] != ordered[:-1]
                group = np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))
                rank = np.empty(len(ordered), np.int64)
                rank[order] = seen[ordered] + np.arange(len(ordered)) - group
                seen += np.bincount(length_of, minlength=size + 1)
                taken = batch.column("doc_id").take(pa.array(rows))
                count = len(rows)
                row_id = (part << 33) + number + np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays([taken, pa.array(row_id), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(count, part), pa.int32()), pa.array(rank)], ["doc_id", "row_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
            number += len(batch)

    return run


# --- the plan -------------------------------------------------------------------------------------------------


#: Patterns kept for every length that occurs, least room first; a round of fitting has so many for each at most.
PER_LENGTH = 3


def enumerate_patterns(lengths: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Multisets of one to four lengths that leave the least room: full pairs and triples, and longer ones built by
    topping two lengths up with the longest that still fits. For every length the best ``PER_LENGTH`` with it are kept."""
    have = sorted(lengths.tolist())
    # every length is topped up together with the frequent ones; all lengths are tried first in some pattern
    frequent = [int(x) for x in lengths[np.argsort(-counts, kind="stable")][:64]]
    found: set[tuple[int, ...]] = {(size,)} if size in set(have) else set()

    def fitting(room: int) -> int | None:
        k = bisect_right(have, room)
        return have[k - 1] if k else None

    for a in have:
        b = fitting(size - a)
        if b is not None:
            found.add(tuple(sorted((a, b), reverse=True)))
        for b in frequent:
            c = fitting(size - a - b) if a + b < size else None
            if c is not None:
                found.add(tuple(sorted((a, b, c), reverse=True)))
                rest = size - a - b - c
                d = fitting(rest) if rest else None
                if d is not None:
                    found.add(tuple(sorted((a, b, c, d), reverse=True)))
    best: set[tuple[int, ...]] = set()
    taken: Counter = Counter()
    for p in sorted(found, key=lambda p: (size - sum(p), len(p), p)):
        if any(taken[x] < PER_LENGTH for x in p):
            best.add(p)
            taken.update(set(p))
    # the fit takes them in this order: long pieces pair off before short ones are used up
    return sorted(best, key=lambda p: (len(p), size - sum(p), p))


def fit_counts(patterns: list[tuple[int, ...]], need: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |W (A x - need)|^2 by cyclic coordinate descent; column p of A counts the
    lengths of pattern p, and W weighs a length by itself, since a long piece that is left over costs most of a sequence."""
    x = np.zeros(len(patterns))
    columns = [np.unique(np.array(p), return_counts=True) for p in patterns]
    weighed = [times * rows.astype(np.float64) ** 2 for rows, times in columns]
    norm = [float(w @ times) for w, (_, times) in zip(weighed, columns, strict=True)]
    rest = need.astype(np.float64).copy()
    for _ in range(sweeps):
        moved = 0.0
        for p, (rows, times) in enumerate(columns):
            step = max(float(rest[rows] @ weighed[p]) / norm[p], -x[p])
            if step:
                x[p] += step
                rest[rows] -= step * times
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def make_plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """``(pattern, repeats)`` pairs that use every piece of the histogram (``histogram[length]``) exactly once."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], repeats: int) -> None:
        for x in pattern:
            left[x] -= repeats
        plan.append((pattern, repeats))

    if left[size]:
        use((size,), int(left[size]))
    # patterns of what is left are fitted again while that packs a good part of it
    while True:
        lengths, before = np.flatnonzero(left), int(left.sum())
        if len(lengths) > 1:
            patterns = [p for p in enumerate_patterns(lengths, left[lengths], size) if sum(p) >= 0.99 * size]
            wanted = np.floor(fit_counts(patterns, left)).astype(np.int64)
            for p in np.argsort(-wanted, kind="stable"):
                pattern = patterns[p]
                rows, times = np.unique(pattern, return_counts=True)
                repeats = min(int(wanted[p]), int((left[rows] // times).min()))
                if repeats > 0:
                    use(pattern, repeats)
        if before - int(left.sum()) <= 0.1 * before:
            break
    # residuals: the longest piece first, then whatever fills the room best
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return plan
        have = lengths.tolist()
        taken: dict[int, int] = {}
        pattern, room = [], size
        while True:
            k = bisect_right(have, room) - 1
            while k >= 0 and left[have[k]] <= taken.get(have[k], 0):
                k -= 1
            if k < 0:
                break
            x = have[k]
            pattern.append(x)
            taken[x] = taken.get(x, 0) + 1
            room -= x
        use(tuple(pattern), min(int(left[x]) // n for x, n in taken.items()))


def plan_intervals(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of every interval, slots a sequence, first sequence, and offsets of the slots."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    sequence = 0
    for pattern, repeats in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in pattern:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            rows.setdefault(x, []).append((used.get(x, 0), len(places), sequence, places))
            used[x] = used.get(x, 0) + repeats * len(places)
        sequence += repeats
    table = {}
    for x, listed in rows.items():
        width = max(len(r[3]) for r in listed)
        table[x] = (np.array([r[0] for r in listed]), np.array([r[1] for r in listed]), np.array([r[2] for r in listed]), np.array([r[3] + [0] * (width - len(r[3])) for r in listed]))
    return table


def _place(table: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                first, slots, base, places = table[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                within = rank[rows] - first[k]
                sequence[rows] = base[k] + within // slots[k]
                offset[rows] = places[k, within % slots[k]]
            names = ["doc_id", "row_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """``doc_id, row_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    ``row_id`` numbers the input's rows, so that ``(row_id, piece)`` is a key where an id stands twice.
    A null or empty text is its end id alone. Repeated rows are packed each. Other columns aren't read. An
    empty table gives an empty table. Sequences number from 0; a sequence's pieces lie gapless from offset 0.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id bigint, row_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"
    pieces = materialize(base.mapInArrow(_pieces(tokenizer_path, size, end_id), schema), "pack-pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # size rows at most
        histogram[r["length"]] = r["n"]
    # pieces of a length that lie in earlier tasks come first: one row per task and length, summed within a length
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "row_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place(plan_intervals(make_plan(histogram, size))), "doc_id bigint, row_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def packed_ids(docs: DataFrame, placed: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, of ``docs`` that ``placed`` was made from.

    Pieces find their ids by document, start and checksum, so that repeated rows and equal ids with other texts are no trouble."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer_path)
        for batch in batches:
            data, at = _text.utf8(batch.column("text"))
            for a, b in _text.chunks(data, at):
                ids, offsets = encoder.batch(data[at[a] : at[b]], at[a : b + 1] - at[a])
                rows = []
                for i in range(b - a):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    rows += [(batch.column("doc_id")[a + i].as_py(), s, zlib.crc32(own[s : s + n].tobytes()), own[s : s + n].tolist()) for s, n in cut(len(own), size)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["doc_id", "start", "ids_crc32", "ids"])

    tokens = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id bigint, start bigint, ids_crc32 bigint, ids array<int>")
    own = tokens.groupBy("doc_id", "start", "ids_crc32").agg(F.first("ids").alias("ids")).alias("t")
    same = F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.start") == F.col("t.start")) & (F.col("p.ids_crc32") == F.col("t.ids_crc32"))
    joined = placed.alias("p").join(own, same).select("sequence_id", "offset", "ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
