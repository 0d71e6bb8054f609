"""N-gram Jaccard join: MinHash banding to find candidates, full shingle sets to verify them.

1. Every text becomes its set of hashed five-word windows and a MinHash signature cut into bands.
   Texts with equal sets form a class of copies and go on as one node.
2. Nodes are shuffled on band hashes. A bucket of many or large nodes is cut into blocks and each pair of
   blocks is a group of its own. A node stands in a group once, however many rows it has, so that no group holds more than
   two blocks, of about ``BLOCK`` nodes and ``BLOCK_SHINGLES`` shingles each, however hot its key.
3. In a group, the full sets of all pairs are compared in one matrix product. A pair counts in the
   first band that its two signatures share. A group gives one row per linked node (its links and the
   least node it is linked to within the group), never a row per pair.
4. Components of those links are the classes returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import discard, look_up, materialize
from .components import connected_components

MAX_HASHES = 160
#: Nodes in a block, and their shingles in all; a group compares two blocks at most.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
_COLUMNS = 4096


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """The (bands, rows) with most rows, so fewest false candidates, whose probability to find a pair
    right at the threshold is ``recall`` or more within ``max_hashes`` hash functions."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall within max_hashes")
    return best


def signature_bands(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    k = bands * rows
    factor = (_text.mix(np.arange(1, k + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shift = (_text.mix(np.arange(5001, k + 5001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _COLUMNS):
        part = x[None, at : at + _COLUMNS] * factor[:, None]
        part += shift[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    with np.errstate(over="ignore"):
        weights = _text.mix(np.arange(9001, rows + 9001, dtype=np.uint64)) | np.uint64(1)
        joined = (least.reshape(bands, rows).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        joined += np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _text.mix(joined).view(np.int64)


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of shingles."""
    with np.errstate(over="ignore"):
        a = _text.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
        b = _text.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _signatures(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, keys, size = [], [], [], []
            for s in _text.shingle_sets(batch.column("text")):
                a, b = set_id(s)
                hi.append(a)
                lo.append(b)
                size.append(len(s))
                keys.append(signature_bands(s, bands, rows) if len(s) else np.empty(0, np.int64))
            sizes = np.cumsum([0, *map(len, keys)])
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], ["id", "digest", "set_hi", "set_lo", "size", "bands"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) >= 2
    keep = shared[column]
    number = np.cumsum(shared) - 1
    column, owner = number[column[keep]], owner[keep]
    total = int(shared.sum())
    for at in range(0, total, _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        part = np.zeros((m, min(_COLUMNS, total - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def linked_pairs(sets: list[np.ndarray], keys: np.ndarray, side: np.ndarray, bucket: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) at or above the threshold, and whether this bucket is the first that they share.

    With members of two blocks (``side`` 0 and 1), pairs within a block belong to other groups."""
    size = np.array([len(s) for s in sets])
    common = intersections(sets)
    union = size[:, None] + size[None, :] - common
    hit = common >= threshold * union - 1e-9
    i, j = np.nonzero(np.triu(hit, 1))
    if len(np.unique(side)) > 1:
        across = side[i] != side[j]
        i, j = i[across], j[across]
    first = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        same = keys[i[at : at + (1 << 16)]] == keys[j[at : at + (1 << 16)]]
        first[at : at + (1 << 16)] = keys[i[at : at + (1 << 16)], same.argmax(axis=1)] == bucket
    return i, j, first


def least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member that each one reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    def group(bucket: int, rows: list[tuple]) -> list[tuple[int, int, int]]:
        # rows: node, set_hi, set_lo, copies, bands, side, text; a node stands here once
        seen: dict[tuple[int, int], tuple] = {}
        for row, s in zip(rows, _text.shingle_sets(pa.array([r[6] for r in rows], pa.large_string())), strict=True):
            if set_id(s) == (row[1], row[2]):
                seen.setdefault((row[0], row[5]), (row, s))
        if len(seen) < 2:
            return []
        members = [seen[k] for k in sorted(seen)]
        node = np.array([r[0] for r, _ in members])
        copies = np.array([r[3] for r, _ in members])
        i, j, first = linked_pairs([s for _, s in members], np.array([r[4] for r, _ in members]), np.array([r[5] for r, _ in members]), bucket, threshold)
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i[first], copies[j[first]])
        np.add.at(links, j[first], copies[i[first]])
        root = least_linked(len(node), i, j)
        out = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
        return [(int(node[k]), int(node[root[k]]), int(links[k])) for k in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int]] = []
        key, rows = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != key:
                    if len(rows) > 1:
                        found += group(key[0], rows)
                    key, rows = row[:3], []
                rows.append(row[3:])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v", "links"])
                found = []
        if len(rows) > 1 and (found := group(key[0], rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v", "links"])

    return run


def ngram_jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, block: int = BLOCK, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Near duplicates by Jaccard similarity of sets of five-word windows.

    Returns one row per input row: the id, ``class_id`` (the least id of its component of links),
    ``n_links`` (rows with other ids or texts whose similarity is ``threshold`` or more, copies
    included) and ``kept`` (true for one (id, text) of each class), with ``text_digest`` beside.

    A pair right at the threshold is a candidate with probability ``recall``, a closer one is nearly sure.
    Texts are compared as split at white space, case included. A text of 1 to 4 words is one window.
    Null and empty texts have the empty set: they are copies of each other. Repeated rows are copies.
    A null id stands for a negative number hashed from the text, returned only as a ``class_id``.
    Other columns are not read, so their names don't matter. An empty table gives an empty table.
    """
    bands, rows = choose_bands(threshold, recall)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.xxhash64(text)
    own = F.coalesce(F.col(id_col).cast("bigint"), -F.shiftrightunsigned(digest, 1) - 1)
    base = docs.select(own.alias("id"), digest.alias("digest"), text.alias("text"))
    signed = materialize(base.mapInArrow(_signatures(bands, rows), "id bigint, digest bigint, set_hi bigint, set_lo bigint, size bigint, bands array<bigint>"), "ngram-signed")

    classes = signed.groupBy("set_hi", "set_lo").agg(F.min(F.struct("id", "digest")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")

    keyed = classes.select("node", "size", F.explode("bands").alias("bucket"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int")
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks")).filter("n > 1").select("bucket", "blocks")
    members = keyed.select("bucket", "node").join(shared, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # one text of each node that shares a bucket, however often its row is repeated
    chosen = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "set_hi", "set_lo", "copies", "bands", "least.id", "least.digest")
    texts = chosen.join(base.join(chosen, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]), ["id", "digest"])
    members = members.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "set_hi", "set_lo", "copies", "bands", (F.col("own") > F.col("other")).cast("int").alias("side"), "text")
    grouped = members.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    found = materialize(grouped.mapInArrow(_compare(threshold), "u bigint, v bigint, links bigint"), "ngram-links")

    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("u", "v")).withColumnRenamed("u", "node")
    placed = classes.select("node", "set_hi", "set_lo", "copies", "least").join(links, "node", "left").join(roots, "node", "left")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "node")), "ngram-rooted")
    least = placed.groupBy("root").agg(F.min("least").alias("class"))
    rooted = placed
    placed = materialize(look_up(rooted, least, "root").select("set_hi", "set_lo", "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "ngram-placed")
    discard(rooted, found, classes)
    out = signed.select("id", "digest", "set_hi", "set_lo").join(placed, ["set_hi", "set_lo"])
    # an id that was null is hashed from its text
    shown = F.when(F.col("id") == -F.shiftrightunsigned(F.col("digest"), 1) - 1, F.lit(None)).otherwise(F.col("id"))
    return out.select(shown.cast("bigint").alias(id_col), F.col("class.id").alias("class_id"), "n_links", ((F.col("id") == F.col("class.id")) & (F.col("digest") == F.col("class.digest"))).alias("kept"), F.col("digest").alias("text_digest"))


def keep_one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The input's rows of which ``ngram_jaccard_join`` keeps the (id, text), one row of each.

    Rows are found again by id and text digest; of fully repeated rows, one stays."""
    joined = ngram_jaccard_join(docs, **options).filter("kept")
    kept = joined.groupBy(F.col("doc_id").alias("id"), F.col("text_digest").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    kept = materialize(kept, "ngram-kept").alias("k")
    # the input's row is one column, so that no name in it can clash
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.digest") == F.col("k.digest"))
    once = keyed.join(kept.filter("n = 1"), same, "left_semi").select("row")
    more = keyed.join(kept.filter("n > 1"), same, "left_semi").dropDuplicates(["id", "digest"]).select("row")
    return once.union(more).select("row.*")
