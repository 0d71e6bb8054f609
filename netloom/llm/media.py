"""Media columns: lossless WebP images decoded into pixel arrays, and texts stored as such images.

A payload's byte is the grey (red, green and blue alike) of a pixel. Every image with more than ``PALETTE_SIZE`` distinct bytes goes through
cross-colour, which takes red and blue to zero, a predictor whose mode each tile chooses by its least differences, copies and a colour
cache; one with fewer through a palette, which puts several pixels in one, and copies.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp

UNIT = 64
#: Bytes of one stored image at most, as the format's greatest height allows; a longer payload is several files in a row.
IMAGE_BYTES = 1 << 20
PALETTE_SIZE, TILE_BITS, COPY = 16, 4, 8
#: Slots of the colour cache, as a power of two. Of 400 test texts a fifth of the symbols was read from 16 slots; by estimate files are 3 % larger than with 2 slots, and 4 % smaller than with 64 or 256.
CACHE_BITS = 4
#: Bytes that are stored and read back together, but for a longer text.
TOGETHER = 1 << 20
#: Bytes that are predicted together: with 14 predictions each they about fit a processor's cache.
CACHED = 1 << 15


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column("media").to_pylist():
            try:
                pixels, _ = webp.decode(data) if data else (None, 0)
                rows.append((None, None, None, None if data else "no image") if pixels is None else (pixels.shape[1], pixels.shape[0], pixels.astype("<u4").tobytes(), None))
            except webp.WebpError as e:
                rows.append((None, None, None, str(e)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]], ["id", "width", "height", "pixels", "error"])


def decode_images(images: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``id, width, height, pixels, error`` of every row: pixels are ARGB, little-endian 32 bits, row by row.

    A null or empty image, and bytes that aren't lossless WebP, give null pixels and an error. Repeated rows stay."""
    base = images.select(F.col(id_col).cast("bigint").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return base.mapInArrow(_decoded, "id bigint, width int, height int, pixels binary, error string")


def to_payload(text: bytes) -> bytes:
    """The text with zeros up to a positive multiple of ``UNIT`` bytes."""
    return text + b"\0" * (-len(text) % UNIT if text else UNIT)


def width_of(size: int) -> int:
    """Pixels across of an image of ``size`` bytes: ``UNIT``, doubled until it is no higher than twice as wide."""
    width = UNIT
    while size > 2 * width * width:
        width *= 2
    return width


def encode_parts(parts: list[np.ndarray]) -> list[bytes]:
    """A file of each part of a payload; a last row that isn't full ends in zeros. Its form depends on its bytes alone."""
    files: dict[int, bytes] = {}
    by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, part in enumerate(parts):
        width = width_of(len(part))
        samples = np.concatenate([part, np.zeros(-len(part) % width, np.uint8)]).reshape(-1, width)
        used = np.flatnonzero(np.bincount(samples.ravel(), minlength=256)).astype(np.uint32)
        if len(used) <= PALETTE_SIZE:
            grey = samples.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
            files[k] = webp.encode(grey, ((webp.PALETTE, used * np.uint32(0x010101) | np.uint32(0xFF000000)),), 0, COPY // 2)
        else:
            by_width.setdefault(width, []).append((k, samples))
    for some in by_width.values():
        ends = np.cumsum([x.size for _, x in some])
        for group in np.unique(ends // CACHED):
            chosen = [some[i] for i in np.flatnonzero(ends // CACHED == group)]
            files |= zip([k for k, _ in chosen], webp.encode_greys([x for _, x in chosen], TILE_BITS, CACHE_BITS, COPY), strict=True)
    return [files[k] for k in range(len(parts))]


def store_all(payloads: list[bytes]) -> list[bytes]:
    """Each payload as one or several files in a row."""
    parts, of = [], []
    for k, payload in enumerate(payloads):
        data = np.frombuffer(payload, np.uint8)
        parts += [data[at : at + IMAGE_BYTES] for at in range(0, len(payload), IMAGE_BYTES)]
        of += [k] * (len(parts) - len(of))
    stored: list[list[bytes]] = [[] for _ in payloads]
    for k, file in zip(of, encode_parts(parts), strict=True):
        stored[k].append(file)
    return [b"".join(files) for files in stored]


def store(payload: bytes) -> bytes:
    """The payload as one or several files in a row."""
    return store_all([payload])[0]


def read_back(media: bytes, size: int) -> bytes:
    """The payload's ``size`` bytes from its stored form."""
    return read_back_all([media], [size])[0]


def read_back_all(stored: list[bytes], sizes: list[int]) -> list[bytes]:
    """Payloads of these sizes from their stored forms."""
    files, of = [], []
    for k, media in enumerate(stored):
        at = 0
        while at < len(media):
            end = at + webp.chunk_of(media[at:])[1]
            files.append(media[at:end])
            of.append(k)
            at = end
    parts: list[list[bytes]] = [[] for _ in stored]
    for k, pixels in zip(of, webp.decode_many(files), strict=True):
        parts[k].append(((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes())
    return [b"".join(p)[:size] for p, size in zip(parts, sizes, strict=True)]


def sample_feature(payload: bytes) -> str:
    """Mean, spread, distinct values and mean step between neighbours of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256).astype(np.float64)
    mean = float((counts * np.arange(256)).sum() / len(x))
    spread = float(np.sqrt(max((counts * (np.arange(256) - mean) ** 2).sum() / len(x), 0.0)))
    step = float(np.abs(np.diff(x.astype(np.int16))).sum() / len(x))
    return f"mean={mean:.4f};std={spread:.4f};values={int((counts > 0).sum())};step={step:.4f}"


def _digests(texts: list[bytes]) -> Iterator[tuple]:
    payloads = [to_payload(t) for t in texts]
    stored = store_all(payloads)
    for text, media, back in zip(texts, stored, read_back_all(stored, [len(p) for p in payloads]), strict=True):
        yield len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), sample_feature(back)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        texts, size, done = [], 0, 0
        for k, text in enumerate(batch.column("text")):
            texts.append((text.as_py() or "").encode("utf-8"))
            size += len(texts[-1])
            if size >= TOGETHER or len(texts) == 1000 or k == batch.num_rows - 1:
                rows = list(_digests(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(rows)), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], ["doc_id", *NAMES])
                texts, size, done = [], 0, k + 1


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and digests of every text's payload as stored in lossless WebP and read back.

    A null text is empty; an empty text is one unit of zeros. Values depend on the text alone. Repeated rows stay.
    Other columns aren't read. An empty table gives an empty table."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInArrow(_stored, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
