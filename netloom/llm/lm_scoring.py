"""LM scoring: log-likelihoods of whole documents by a gated recurrent model, beside a unigram base.

1. Texts are laid into blocks of about ``BLOCK_BYTES``; a block gives a row for each of its distinct words. Their counts
   over all training texts are a plain grouped sum.
2. The words with an output of their own (about the root of the vocabulary) go to the driver and into every task. The
   network is trained on all segments of every training text. Slots of about ``SLOT_TOKENS`` are trained on side by side, and their weights averaged
   in Spark after each of ``ROUNDS`` rounds, which have a part of the slots each.
3. Blocks look up the counts of their other words, those in many blocks by broadcast, and meet them in one task each, where every text is scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text, gru_lm
from ._labels import fold
from ._store import discard, look_up, materialize, release

BLOCK_BYTES = 8 << 20
#: Share of the training tokens that the network is trained on, in segments of this many tokens.
FIT_SHARE, SEGMENT = 1.0, 96
SLOT_TOKENS = 1_000_000
ROUNDS = 3
END = np.uint64(0x9D5C0FB1A3E7426B)
SMOOTH = 0.1


def word_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of every text's words, A-Z lowered, with an end token after each; n+1 offsets."""
    n = len(at) - 1
    keys, counts = [], np.zeros(n, np.int64)
    for a, b in _text.chunks(data, at):
        part, offs = _text.LOWER[data[at[a] : at[b]]], at[a : b + 1] - at[a]
        starts, ends, first = _text.words(part, offs)
        hashed = _text.mix(_text.span_hashes(part, starts, ends))
        keys.append(np.insert(hashed, first[1:], END))
        counts[a:b] = np.diff(first) + 1
    return (np.concatenate(keys) if keys else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def _lay_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number consecutive rows so that a block has about BLOCK_BYTES of text."""
    block, size = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        _, at = _text.utf8(batch.column("text"))
        ends = at[1:] + size
        number = block + ends // BLOCK_BYTES
        if len(number):
            size = int(ends[-1]) % BLOCK_BYTES
            block = int(number[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], [*batch.schema.names, "block"])


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct words, with their number in its training texts. A block lies in one task, its rows in a row."""
    held: tuple[int, np.ndarray, np.ndarray] | None = None

    def send() -> pa.RecordBatch:
        block, keys, counts = held
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys.view(np.int64)), pa.array(counts)], ["block", "word", "n"])

    for batch in batches:
        number, train = np.asarray(batch.column("block")), 1 - np.asarray(batch.column("held_out").cast(pa.int64()))
        for block in np.unique(number).tolist():
            rows = np.flatnonzero(number == block)
            keys, first = word_keys(*_text.utf8(batch.column("text").take(pa.array(rows))))
            counts = np.repeat(train[rows], np.diff(first))
            if held is not None and held[0] != block:
                yield send()
                held = None
            if held is not None:
                keys, counts = np.concatenate([held[1], keys]), np.concatenate([held[2], counts])
            once, back = np.unique(keys, return_inverse=True)
            held = (block, once, np.bincount(back, counts, minlength=len(once)).astype(np.int64))
    if held is not None:
        yield send()


def frequent_words(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the ``size`` words with most tokens, most frequent first, then by key.

    A histogram by powers of two gives a bound that few more than ``size`` words reach; only these are sorted."""
    bits = counts.filter("n > 0").groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("bits")).collect()
    above, least = 0, 1
    for r in bits:  # 63 rows at most
        above, least = above + r["words"], 1 << (r["bits"] - 1)
        if above >= size:
            break
    rows = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).collect()
    return np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)


def word_places(keys: np.ndarray, top: np.ndarray, others: int) -> np.ndarray:
    """Each key's rank among the frequent words, or ``others``."""
    if not len(top):
        return np.full(len(keys), others)
    order = np.argsort(top)
    at = np.minimum(np.searchsorted(top[order], keys), len(top) - 1)
    return np.where(top[order][at] == keys, order[at], others)


def chosen_segments(keys: np.ndarray, first: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, hash)`` of the segments to train on: those whose hash of text and place is below ``share``, and of every
    text the one with the lowest."""
    sizes = np.diff(first)
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), parts)
    place = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[:-1][owner] + place * SEGMENT
    end = np.minimum(start + SEGMENT, first[1:][owner])
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    within = np.arange(len(keys)) - np.repeat(first[:-1], sizes)
    text = np.add.reduceat(_text.mix(keys + within.astype(np.uint64)), first[:-1])
    hashed = _text.mix(text[owner] + place.astype(np.uint64))
    least = np.minimum.reduceat(hashed, np.cumsum(parts) - parts)
    if share >= 1:
        return start, end, hashed
    taken = (hashed < np.uint64(share * (2**64 - 2**11))) | (hashed == least[owner])
    return start[taken], end[taken], hashed[taken]


def _segments(top: np.ndarray, others: int, slots: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _text.utf8(batch.column("text"))
            for a, b in _text.chunks(data, at):
                keys, first = word_keys(data[at[a] : at[b]], at[a : b + 1] - at[a])
                start, end, hashed = chosen_segments(keys, first, share)
                size = end - start
                offsets = np.concatenate([[0], np.cumsum(size)])
                taken = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
                places = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(word_places(keys[taken], top, others), pa.int32()))
                slot = (_text.mix(hashed) % np.uint64(slots)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(hashed.view(np.int64)), places], ["slot", "hash", "places"])

    return run


def _train_slot(weights: gru_lm.Weights, number: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        # in the order of hashes, so that the layout of the input doesn't matter
        table = table.sort_by("hash")
        places = table.column("places").combine_chunks()
        words, size = np.asarray(places.flatten()), np.asarray(places.value_lengths())
        begins = np.zeros(len(words), bool)
        begins[np.cumsum(size) - size] = True
        fitted = gru_lm.train(weights, words, begins, 0.01 / (1 + number))
        parts = gru_lm.to_parts(fitted)
        values = pa.array([(p.astype(np.float64) * len(words)).tobytes() for p in parts], pa.binary())
        return pa.table([pa.array([key[0].as_py()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([len(words)] * len(parts), pa.int64()), values], ["slot", "part", "size", "sums"])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    table = table.sort_by("slot")
    total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
    return pa.table([table.column("slot")[:1], table.column("part")[:1], pa.array([sum(table.column("size").to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slot", "part", "size", "sums"])


def fit(segments: DataFrame, slots: int, start: gru_lm.Weights, rounds: int = ROUNDS) -> gru_lm.Weights:
    """Weights averaged by tokens over a round's slots. Two steps of adding up hold about the root of the slots' number each."""
    weights, schema = start, "slot bigint, part int, size bigint, sums binary"
    step = max(1, math.isqrt(slots))
    for number in range(rounds):
        trained = segments.filter(F.col("slot") % rounds == number).groupBy("slot").applyInArrow(_train_slot(weights, number), schema)
        some = trained.withColumn("slot", F.expr(f"slot DIV {step}")).groupBy("part", "slot").applyInArrow(_add_up, schema)
        rows = some.groupBy("part").applyInArrow(_add_up, schema).orderBy("part").collect()
        if rows:
            weights = gru_lm.from_parts([np.frombuffer(bytes(r["sums"]), np.float64) / r["size"] for r in rows], start)
        release(segments.sparkSession)
    return weights


def _score(weights: gru_lm.Weights, top: np.ndarray, top_counts: np.ndarray, n: int, v: int):
    others_at = gru_lm.place_of_others(weights)
    others = n - int(top_counts.sum()) + SMOOTH * (v - len(top) + 1)

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        # the block's words: frequent ones first, then its others; words that no training text has aren't there
        table = np.concatenate([top, np.asarray(known.column("word")).view(np.uint64)])
        counts = np.concatenate([top_counts, np.asarray(known.column("n"))])
        order = np.argsort(table)
        table, counts, place_of = table[order], counts[order], np.where(order < len(top), order, others_at).astype(np.int32)
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        data, at = _text.utf8(texts.column("text"))
        for a, b in _text.chunks(data, at, 4 << 20):
            keys, first = word_keys(data[at[a] : at[b]], at[a : b + 1] - at[a])
            c, place = np.zeros(len(keys)), np.full(len(keys), others_at, np.int32)
            if len(table):
                found = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                known_word = table[found] == keys
                c[known_word], place[known_word] = counts[found[known_word]], place_of[found[known_word]]
            log = np.log10(c + SMOOTH)
            spread = lambda x: np.add.reduceat(x, first[:-1])
            rare = place == others_at
            size = np.diff(first)
            base = spread(log) - size * np.log10(n + SMOOTH * (v + 1))
            share = spread(np.where(rare, log, 0.0)) - spread(rare.astype(np.float64)) * np.log10(others)
            for column, x in zip(parts, (place, size, spread((c > 0).astype(np.float64)), base, share), strict=True):
                column.append(x)
        place, size, seen, base, share = (np.concatenate(x) if x else np.empty(0, np.int64) for x in parts)
        # all of a block's texts side by side, so that its longest one has company
        score = share + gru_lm.document_logs(weights, place, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)) / np.log(10)
        columns = [pa.array(size.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(np.full(len(size), n), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
        return pa.table([texts.column("doc_id"), texts.column("held_out"), *columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, folds: int = 10, held_out: int = 0, fit_share: float = FIT_SHARE) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per input row.

    Counts are learned from every row whose id's CRC-32 modulo ``folds`` isn't ``held_out``; a null id counts as
    the empty text. The network is trained on ``fit_share`` of those rows' tokens, a segment of every text at least.
    A null or empty text is its end token. Without training rows N and V are 0 and both
    scores are 0. Repeated rows count and stay each. Other columns aren't read. An empty table gives an empty table.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (fold("doc_id", folds) == held_out).alias("held_out"))
    laid = materialize(base.mapInArrow(_lay_blocks, "doc_id bigint, text string, held_out boolean, block bigint"), "lm-blocks", codec="zstd")
    words = materialize(laid.mapInArrow(_block_words, "block bigint, word bigint, n bigint"), "lm-words", codec="zstd")
    # a word's count is a plain grouped sum, which tasks add up beforehand; a common word has a row in every block
    counts = words.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
    counts = materialize(counts.filter("n > 0"), "lm-counts", codec="zstd")
    release(docs.sparkSession)
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n, v = int(totals[0] or 0), int(totals[1])
    side = gru_lm.side_of(v)
    top, top_counts = frequent_words(counts, side * side)
    start = gru_lm.start_weights(top_counts.astype(np.float64), n - int(top_counts.sum()) + SMOOTH * (v - len(top) + 1), side)

    slots = max(1, int(n * min(fit_share, 1.0)) // SLOT_TOKENS)
    chosen = laid.filter("NOT held_out").select("text").mapInArrow(_segments(top, side * side, slots, fit_share), "slot bigint, hash bigint, places array<int>")
    segments = materialize(chosen, "lm-segments", codec="zstd")
    weights = fit(segments, slots, start)
    discard(segments)
    release(docs.sparkSession)

    # frequent words stand in every block and are in each task already (at most the root of the vocabulary is broadcast)
    frequent = docs.sparkSession.createDataFrame([(int(k),) for k in top.view(np.int64)], "word bigint")
    rest = words.select("block", "word").join(F.broadcast(frequent), "word", "left_anti")
    known = look_up(rest, counts.select("word", "n"), "word", counts.select("word", F.col("blocks").alias("__rows")).join(F.broadcast(frequent), "word", "left_anti"))
    known = known.select("block", "word", "n")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return laid.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score(weights, top, top_counts, n, v), schema)
