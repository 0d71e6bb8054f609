"""Vector code compression: product codes of integer vectors, whose codebook searches are cut short by segment-mean lower bounds.

A vector's part and a codebook entry are summarised by the means of their blocks, from coarse to fine, and by the norm of what the means
leave over. The sum of ``(difference of means)**2 * block length`` and of the squared difference of those norms is never above
the squared distance, so an entry whose bound lies over the best known distance is left out. Survivors get exact integer distances.

Every round reads the vectors once, adds up their parts by (part, entry) in the tasks and then in Spark; the codebooks, whose size is
``ENTRIES`` times a vector's, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import look_up, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows whose distances are taken at once.
BATCH = 8192
#: Bounds are taken in doubles; a bound must lie over the best distance by more than their error to leave an entry out.
SLACK, LEAST_SLACK = 1e-9, 1.0


def component_bound(width: int) -> int:
    """The greatest magnitude of an integer component of vectors of ``width`` at which no distance leaves 64 bits."""
    return 1 << ((62 - max(width - 1, 0).bit_length()) // 2 - 1)


def integer_vectors(values: np.ndarray, width: int) -> np.ndarray:
    """``floor(SCALE * x)``, within ``component_bound``."""
    bound = component_bound(width)
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -bound, bound).astype(np.int64)


def block_levels(length: int) -> list[np.ndarray]:
    """Starts of the blocks of each level, coarse to fine: one block, then twice as many, while blocks have two elements."""
    levels, n = [], 1
    while n <= max(1, length // 2):
        levels.append(np.unique(np.arange(n) * length // n))
        n *= 2
    return levels if length else []


class Summary:
    """Block means times the root of the block's length, and the norm of the rest, at one level; rows of an integer matrix."""

    def __init__(self, rows: np.ndarray, starts: np.ndarray):
        size = np.diff(np.append(starts, rows.shape[1]))
        x = rows.astype(np.float64)
        means = np.add.reduceat(x, starts, axis=1) / size
        self.means = means * np.sqrt(size)
        self.rest = np.sqrt(((x - np.repeat(means, size, axis=1)) ** 2).sum(axis=1))


def lower_bounds(a: Summary, b: Summary, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bounds from below of the squared distances of rows ``i`` of one and ``j`` of the other matrix, less the doubles' error."""
    bound = ((a.means[i] - b.means[j]) ** 2).sum(axis=1) + (a.rest[i] - b.rest[j]) ** 2
    return bound * (1 - SLACK) - LEAST_SLACK


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, the first of equally near ones, and its squared distance; integers throughout."""
    n, k = len(rows), len(entries)
    exact = lambda i, j: ((rows[i] - entries[j]) ** 2).sum(axis=1)
    levels = block_levels(rows.shape[1])
    i, j = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    best = None
    for starts in levels:
        a, b = Summary(rows, starts), Summary(entries, starts)
        bound = lower_bounds(a, b, i, j)
        if best is None:
            # the entry with the least coarse bound gives the first distance to beat
            guess = bound.reshape(n, k).argmin(axis=1)
            best = exact(np.arange(n), guess)
        kept = bound <= best[i]
        i, j = i[kept], j[kept]
    distance = exact(i, j)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # survivors stand by row, then entry; every row has one at least
    first = np.searchsorted(i, np.arange(n))
    least = np.minimum.reduceat(distance, first)
    chosen = np.where(distance == least[i], j, k)
    return np.minimum.reduceat(chosen, first), least


def _padded(width: int) -> int:
    return -(-width // PARTS) * PARTS


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(column.flatten()).reshape(-1, width) if width else np.empty((len(column), 0))
    whole = integer_vectors(flat, width)
    return np.pad(whole, ((0, 0), (0, _padded(width) - width)))


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with their integer parts (n, PARTS, length), entries and squared distances."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            rows = _matrix(batch.column("vector"), width).reshape(batch.num_rows, PARTS, -1)
            found = [nearest(rows[:, p], books[p]) for p in range(PARTS)]
            yield batch, rows, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _part_sums(books: np.ndarray, width: int):
    """Each task's sums and counts by (part, entry), a row for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, rows, code, _ in _assigned(batches, books, width):
            for p in range(PARTS):
                np.add.at(sums[p], code[:, p], rows[:, p])
                counts[p] += np.bincount(code[:, p], minlength=books.shape[1])
        part, entry, place = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, books.shape))
        columns = (part, entry, place, sums[part, entry, place], counts[part, entry])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "total", "n"])

    return run


def _codes(books: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, code, distance in _assigned(batches, books, width):
            text = ["".join(f"{x:02x}" for x in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(distance.sum(axis=1), pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def usable_vectors(embeddings: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vec_id, label, vector`` of rows whose vector holds finite numbers alone."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vector").isNotNull() & ~odd)


def fit_codebooks(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[np.ndarray, int, DataFrame]:
    """The codebooks ``(PARTS, entries, length)`` after all rounds, the width of the vectors, and those vectors that have it.

    A sum stays in 64 bits for 2**62 / ``component_bound`` rows of an entry; Spark adds the tasks' sums as decimals."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = vectors.orderBy(*order).limit(1).collect()
    if not first:
        return np.empty((PARTS, 0, 0), np.int64), 0, vectors.filter("false")
    width = len(first[0]["vector"])
    vectors = vectors.filter(F.size("vector") == width)
    heads = vectors.orderBy(*order).limit(entries).collect()
    books = np.pad(integer_vectors(np.array([r["vector"] for r in heads]).reshape(len(heads), width), width), ((0, 0), (0, _padded(width) - width)))
    books = np.ascontiguousarray(books.reshape(len(heads), PARTS, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        tasks = vectors.mapInArrow(_part_sums(books, width), "part bigint, entry bigint, place bigint, total bigint, n bigint")
        sums = tasks.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():  # a codebook's components
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books, width, vectors


def codebooks_digest(books: np.ndarray, width: int) -> str:
    """SHA-256 of all components in order of part, entry and place; padding isn't part of it."""
    length = _padded(width) // PARTS
    shown = [str(books[p, e, x]) for p in range(books.shape[0]) for e in range(books.shape[1]) for x in range(length) if p * length + x < width]
    return hashlib.sha256(",".join(shown).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, vector_col: str = "embedding", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector.

    Rows whose vector is null or holds a null or non-finite component are left out, as are vectors of another width than that of the least id; a
    width that ``PARTS`` doesn't divide is filled up with zeros. Null ids stay, count as greatest, and equal ids are ordered by their vectors;
    with fewer rows than entries the codebooks are smaller. Ties go to the lower entry. Repeated rows stay and count each.
    Integer components beyond ``component_bound`` (2**27 at a width of 64, for values over 32,768) are set to it, so that every distance fits 64 bits.
    A null label is one label. Other columns aren't read; an empty table gives an empty table."""
    books, width, vectors = fit_codebooks(usable_vectors(embeddings, vector_col), rounds, entries)
    coded = vectors.mapInArrow(_codes(books, width), "vec_id bigint, label string, code string, error bigint") if books.shape[1] else vectors.selectExpr("vec_id", "label", "'' AS code", "0L AS error")
    coded = materialize(coded.withColumn("label", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = look_up(coded, sums, "label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books, width)).alias("codebooks_sha256"))
