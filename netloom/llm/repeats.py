"""Suffix-array dedup: bytes covered by a string of ``LEAST`` bytes that also starts anywhere else.

1. Of every window of ``LEAST`` bytes the gram with the least hash (the leftmost of equal ones) is its anchor. Consecutive windows with
   one anchor occurrence are a run, and the bytes under a run a slice. Equal windows have equal anchors at equal offsets, so they lie in runs of equal
   keys, and no two windows of a run are equal. A text gives a row for each of its runs (about one in 80 bytes).
2. Equal slices are one slice with a count, added up before anything meets. A slice that stands twice repeats wherever it stands.
3. Different slices of one key, one of each, are cut from their texts and dealt by key. A task lays them side by side and finds the
   windows that repeat by interval expansion on their Burrows-Wheeler transform (``bwt``). A key with more than ``BLOCK`` different slices is
   narrowed: a slice's windows are told apart by the bytes that they have before the anchor, and cut into ``PARTS`` ranges of those. All windows
   of a range hold the same middle of the slice, so only slices that are alike there can share one; slices alike in the whole range share all
   of it, and one of them stands for the others. Groups that are still large are cut again, down to one window.
4. Spans of a text are merged and cut out of it, once for all of its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text, bwt
from ._store import discard, look_up, materialize, release

#: Bytes of a repeated string, and of an anchor within it.
LEAST, GRAM = 200, 40
#: Different slices of one key in a block, and bytes of slices that are compared at once.
BLOCK, CHUNK = 1024, 1 << 20
#: Ranges that a group of more than ``BLOCK`` slices is cut into.
PARTS = 4
#: Bits of a place within a piece of text; the rest of 64 are the anchor's hash.
PLACE_BITS = 20
PIECE = (1 << PLACE_BITS) - 1024
SEPARATOR = 0xFF  # stands in no UTF-8 text

_BYTES = _text.mix(np.arange(70_000, 70_512, dtype=np.uint64)).reshape(2, 256)
_BASES = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, ``n`` at least; kept, a piece of text long at most."""
    held = _POWERS.get(which)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 12)
        with np.errstate(over="ignore"):
            held = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)])) for base in (np.uint64(_BASES[which]), np.uint64(pow(_BASES[which], -1, 1 << 64))))
        _POWERS[which] = held
    return held[0][:n], held[1][:n]


def gram_hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each place on, by differences of one running sum."""
    n = len(data)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = _powers(which, n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * up, out=total[1:])
        return _text.mix((total[length:] - total[:-length]) * down[: n - length + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def window_runs(data: np.ndarray, at: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, start, size, key)`` of the runs of texts that lie side by side, ``PIECE`` bytes at most; ``start`` counts in ``data``."""
    starts = np.diff(at) - least + 1
    owner = np.repeat(np.arange(len(starts)), np.maximum(starts, 0))
    if not len(owner):
        return (np.empty(0, np.int64),) * 4
    kept = np.maximum(starts, 0)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(kept) - kept, kept) + at[owner]
    hashed = gram_hashes(data, gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    anchors = sliding_least((hashed & ~low) | np.arange(len(hashed), dtype=np.uint64), least - gram + 1)[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    return owner[first], window[first], count + least - 1, (anchors[first] >> np.uint64(PLACE_BITS)).astype(np.int64)


def text_runs(data: np.ndarray, at: np.ndarray, least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """``(text, start, size, key, digest, n)`` of all runs of all texts, ``start`` within the text. Runs of equal slices that follow each other
    in a text are one row, ``n`` times as many windows long."""
    for a, b in _text.chunks(data, at, PIECE):
        pieces = [(at[a], at[b], at[a : b + 1] - at[a])]
        if at[b] - at[a] > PIECE:  # one long text: pieces overlap by a window less one byte
            pieces = [(x, y := min(x + PIECE, int(at[b])), np.array([0, y - x])) for x in range(int(at[a]), int(at[b]) - least + 1, PIECE - least + 1)]
        for x, y, offsets in pieces:
            part = data[x:y]
            owner, start, size, key = window_runs(part, offsets, least, gram)
            if not len(owner):
                continue
            view = memoryview(part.tobytes())
            digest = np.frombuffer(b"".join([hashlib.blake2b(view[s:e], digest_size=8).digest() for s, e in zip(start.tolist(), (start + size).tolist(), strict=True)]), np.int64)
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(owner)))
            yield owner[first] + a, (start + x - at[owner + a])[first], size[first], key[first], digest[first], n


def _runs(least: int, gram: int):
    names = ["key", "digest", "h1", "h2", "start", "size", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (np.asarray(batch.column(c)) for c in ("h1", "h2"))
            for text, start, size, key, digest, n in text_runs(*_text.utf8(batch.column("text")), least, gram):
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (key, digest, h1[text], h2[text], start)], *[pa.array(x, pa.int32()) for x in (size, n)]], names)

    return run


RUNS = "key bigint, digest bigint, h1 bigint, h2 bigint, start bigint, size int, n int"


def anchor_at(piece: bytes, gram: int) -> int:
    """Where in a slice its anchor begins."""
    hashed = gram_hashes(np.frombuffer(piece, np.uint8), gram)
    return int(np.argmin(hashed >> np.uint64(PLACE_BITS)))


def _cut(gram: int):
    """The slices that ``wanted`` names, cut from each text; of split keys also the place of the anchor."""
    names = ["key", "split", "alone", "start", "h1", "h2", "slice", "anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _text.utf8(batch.column("text"))
            raw = data.tobytes()
            for k in range(batch.num_rows):
                wanted = batch.column("wanted").slice(k, 1).flatten()
                cols = {c: wanted.field(c).to_pylist() for c in ("start", "size", "split")}
                parts = [raw[at[k] + s : at[k] + s + z] for s, z in zip(cols["start"], cols["size"], strict=True)]
                anchors = [anchor_at(x, gram) if split else 0 for x, split in zip(parts, cols["split"], strict=True)]
                same = [pa.array(np.full(len(parts), batch.column(c)[k].as_py()), pa.int64()) for c in ("h1", "h2")]
                yield pa.RecordBatch.from_arrays([*[wanted.field(c) for c in ("key", "split", "alone", "start")], *same, pa.array(parts, pa.binary()), pa.array(anchors, pa.int32())], names)

    return run


def _spans_of(starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and lengths of the stretches that the windows at sorted ``starts`` cover."""
    if not len(starts):
        return starts, starts
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + least
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] + least - starts[first]


def _compare(least: int, chunk: int):
    """Spans of slices that stand alone, by windows that other slices of their group have too."""
    names = ["h1", "h2", "start", "length"]

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        # rows: key, group, alone, start, h1, h2, slice
        sizes = np.array([len(r[6]) for r in rows])
        data = np.frombuffer(bytes([SEPARATOR]).join([r[6] for r in rows] + [b""]), np.uint8)
        base = np.cumsum(sizes + 1) - sizes - 1
        owner = np.repeat(np.arange(len(rows)), sizes + 1)
        place = np.arange(len(data)) - base[owner]
        valid = place <= sizes[owner] - least
        again = bwt.repeated_starts(data, valid, least)
        alone = np.array([r[2] for r in rows])
        start, h1, h2 = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        # slices lie apart by a separator, and a window never reaches over it
        first, length = _spans_of(np.flatnonzero(again & alone[owner]), least)
        of = owner[first]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h1[of], h2[of], place[first] + start[of], length)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:2] != last and held >= chunk:
                    yield compare(rows)
                    rows, held = [], 0
                last = row[:2]
                rows.append(row)
                held += len(row[6]) + 1
        if rows:
            yield compare(rows)

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without its spans."""
    for batch in batches:
        data, at = _text.utf8(batch.column("text"))
        raw = data.tobytes()
        spans = batch.column("spans")
        removed, runs, digest = [], [], []
        for k in range(batch.num_rows):
            text = raw[at[k] : at[k + 1]]
            gone, n, kept, reached = 0, 0, hashlib.sha256(), 0
            of = spans.slice(k, 1).flatten()
            start, length = (np.asarray(of.field(c)) for c in ("start", "length"))
            end = -1
            for i in np.argsort(start, kind="stable").tolist():
                s, e = int(start[i]), int(start[i] + length[i])
                if s > end:  # apart from what came before
                    n += 1
                    kept.update(text[reached:s])
                elif e <= end:
                    continue
                gone += e - max(s, reached)
                reached = end = e
            kept.update(text[reached:])
            removed.append(gone)
            runs.append(n)
            digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _half(text: Column, first: int) -> Column:
    return F.conv(F.substring(F.md5(text), first, 16), 16, -10).cast("bigint")


def _narrowed(slices: DataFrame, least: int, gram: int, block: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of groups (key, group, alone, start, h1, h2, slice, different): those of ``block`` different slices at most hold what is left to compare. And tables of spans that are known already.

    ``slices``: key, alone, start, h1, h2, slice, anchor. A window has ``w`` bytes beside its anchor, ``least`` less ``gram``, and ``a`` of them before it; a row stands for the
    windows of its slice whose ``a`` lies within ``low`` to ``high``. No window of a slice is in two rows, and ranges of a slice never overlap."""
    spark, w = slices.sparkSession, least - gram
    tables, spans = [], []
    live, width = slices.withColumn("low", F.lit(0)).withColumn("group", F.lit(0).cast("bigint")), w + 1
    while width > 1:
        width, before = -(-width // PARTS), width
        cuts = F.array(*[F.lit(x) for x in range(0, before, width)])
        ranges = live.withColumn("from", F.explode(cuts)).withColumn("low", F.col("low") + F.col("from"))
        high = F.least(F.col("low") + F.lit(width - 1), F.col("low") - F.col("from") + F.lit(before - 1), F.lit(w))
        ranges = ranges.withColumn("high", high)
        # what of the range the slice has: a window before its first has too few bytes ahead of the anchor, one after its last too few behind
        fewest = F.col("anchor") - F.octet_length("slice") + F.lit(least)
        ranges = ranges.withColumns({"own_low": F.greatest("low", fewest), "own_high": F.least("high", F.col("anchor"))}).filter("own_low <= own_high")
        part = lambda a, b: F.substring(F.col("slice"), F.col("anchor") - a + 1, F.lit(gram) + a + F.lit(w) - b)
        middle = F.xxhash64("group", "low", part(F.col("low"), F.col("high")))
        whole = part(F.col("own_high"), F.col("own_low"))
        ranges = ranges.select("key", middle.alias("group"), "low", "own_low", "own_high", F.md5(whole).alias("digest"), "alone", (F.col("start") + F.col("anchor") - F.col("own_high")).alias("start"), "h1", "h2", whole.alias("slice"), F.col("own_high").alias("anchor"))
        ranges = materialize(ranges, "repeats-ranges")
        # slices alike in all that they have of a range: one stands for them
        alike = ["key", "group", "own_low", "own_high", "digest"]
        one = F.min_by(F.struct("alone", "start", "h1", "h2", "slice", "anchor", "low"), F.struct("h1", "h2", "start"))
        once = materialize(ranges.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"), one.alias("one")), "repeats-once")
        several = once.filter("n > 1").select(*alike, F.col("n").alias("__rows"))
        same = look_up(ranges.filter("alone"), several.drop("__rows"), alike, several)
        spans.append(materialize(same.select("h1", "h2", "start", F.octet_length("slice").cast("bigint").alias("length")), "repeats-alike"))
        sizes = once.groupBy("key", "group").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
        sizes = materialize(sizes, "repeats-groups")
        left = once.select("key", "group", "n", "one.*").withColumn("alone", F.col("alone") & (F.col("n") == 1)).drop("n")
        left = materialize(look_up(left, sizes, ["key", "group"], sizes.withColumnRenamed("different", "__rows")), "repeats-left")
        discard(ranges, once, sizes)
        tables.append(left)
        live = left.filter(F.col("different") > block).drop("different")
        release(spark)
        if live.isEmpty():
            break
    return tables, spans


def repeated_spans(texts: DataFrame, least: int = LEAST, gram: int = GRAM, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``h1, h2, start, length`` of stretches of the texts ``(h1, h2, text)`` whose bytes are covered; stretches of a text may overlap.

    A text is a row as often as it stands; rows with equal (h1, h2) have equal texts, and equal stretches of them are given once."""
    spark = texts.sparkSession
    runs = texts.mapInArrow(_runs(least, gram), RUNS)
    merged = runs.groupBy("key", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("h1", "h2", "start")).alias("at"), F.first("size").alias("size"))
    slices = materialize(merged, "repeats-slices")
    release(spark)
    keys = materialize(slices.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("n")).filter("n > 1").select("key", "different"), "repeats-keys")
    shared = materialize(look_up(slices, keys, "key", keys.select("key", F.col("different").alias("__rows"))), "repeats-shared")
    discard(slices, keys)
    release(spark)

    # one of each of the different slices of a key
    several = shared.filter("different > 1").select("at.*", "key", "size", (F.col("n") == 1).alias("alone"), (F.col("different") > block).alias("split"))
    wanted = several.groupBy("h1", "h2").agg(F.collect_list(F.struct("key", "split", "alone", "start", "size")).alias("wanted"))
    once = texts.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    cut = once.join(wanted, ["h1", "h2"]).mapInArrow(_cut(gram), "key bigint, split boolean, alone boolean, start bigint, h1 bigint, h2 bigint, slice binary, anchor int")
    narrowed, alike = [], []
    if not several.filter("split").isEmpty():
        cut = materialize(cut, "repeats-cut")
        narrowed, alike = _narrowed(cut.filter("split").drop("split"), least, gram, block)
    columns = ["key", "group", "alone", "start", "h1", "h2", "slice"]
    few = [cut.filter("NOT split").withColumn("group", F.lit(0).cast("bigint")), *[t.filter(F.col("different") <= block) for t in narrowed]]
    dealt = reduce(DataFrame.unionByName, [t.select(*columns) for t in few]).repartition("key", "group").sortWithinPartitions("key", "group")
    found = materialize(dealt.mapInArrow(_compare(least, chunk), "h1 bigint, h2 bigint, start bigint, length bigint"), "repeats-found")
    discard(cut, *narrowed)
    release(spark)

    twice = shared.filter("n > 1").select("key", "digest", "n")
    whole = look_up(runs, twice.drop("n"), ["key", "digest"], twice.withColumnRenamed("n", "__rows"))
    covered = F.col("size") + (F.col("n") - 1) * (F.col("size") - F.lit(least - 1))
    names = ["h1", "h2", "start", "length"]
    spans = reduce(DataFrame.unionByName, [whole.select("h1", "h2", "start", covered.cast("bigint").alias("length")), found.select(*names), *alike])
    spans = materialize(spans.distinct(), "repeats-spans")
    discard(found, shared, *alike)
    release(spark)
    return spans


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row: its text's bytes less those covered by a string of ``least``
    bytes that also starts anywhere else, in this or another row.

    A null text is empty; texts under ``least`` bytes lose nothing. Rows that repeat a text of ``least`` bytes or more lose all of it, also rows with
    equal or null ids. Bytes are those of UTF-8, so a cut may fall within a character. Other columns aren't read; an empty table gives an empty table.
    Texts are told apart by their MD5, slices of one anchor by 64 bits of BLAKE2."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _half(text, 1).alias("h1"), _half(text, 17).alias("h2"), text.alias("text"))
    texts = rows.select("h1", "h2", "text")
    spans = repeated_spans(texts, least, gram, block, chunk)
    listed = spans.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    once = texts.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    joined = once.join(listed, ["h1", "h2"], "left").select("h1", "h2", "text", F.coalesce("spans", F.array().cast("array<struct<start: bigint, length: bigint>>")).alias("spans"))
    cleaned = materialize(joined.mapInArrow(_removed, "h1 bigint, h2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"), "repeats-cleaned")
    discard(spans)
    release(docs.sparkSession)
    ids = materialize(rows.select("doc_id", "h1", "h2"), "repeats-ids")
    return look_up(ids, cleaned, ["h1", "h2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
