"""pcap files as DataFrames: captures, their packets, warnings and totals, and packets as the bytes of a file.

Files are read by Spark's ``binaryFile``, so from any store, one task a file: record boundaries are only found from the front.
A file is at most 2 GB there, the limit of a value. Files in parts (``as_parts``, ``read_parts``) may be longer: their task holds a few parts at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions.headers import hexed
from netloom.stored import materialize

# Fixed values of the format: magic numbers as little-endian bytes give byte order and nanoseconds a unit of the fraction.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
PCAPNG = b"\x0a\x0d\x0d\x0a"
MODIFIED = {b"\x34\xcd\xb2\xa1", b"\xa1\xb2\xcd\x34"}
#: Most bytes of a record, by link type; others hold 262,144.
RECORD_BYTES, LINK_BYTES = 262_144, {231: 128 << 20, 279: 8 << 20, 189: 1 << 20, 220: 1 << 20, 249: 1 << 20}


class CaptureError(ValueError):
    """A file that can't be read on, with a stable code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def parse_header(data: bytes) -> dict:
    """Byte order, unit, version, snapshot length and link type of a file."""
    if len(data) >= 4 and data[:4] == PCAPNG or data[:4] in MODIFIED:
        raise CaptureError("unsupported_format", "another capture format")
    if len(data) >= 4 and data[:4] not in MAGIC:
        raise CaptureError("invalid_magic", "no capture file")
    if len(data) < 24:
        raise CaptureError("truncated_global_header", "the file ends in its header")
    order, unit = MAGIC[data[:4]]
    major, minor, _, _, snaplen, link = struct.unpack(order + "HHiIII", data[4:24])
    if (major, minor) not in {(2, m) for m in range(5)}:
        raise CaptureError("invalid_version", f"version {major}.{minor}")
    if snaplen == 0:
        raise CaptureError("invalid_snap_length", "a snapshot length of 0")
    if link >> 16 & 0x3FF:
        raise CaptureError("corrupt_global_header", "reserved bits are set")
    return {"order": order, "unit": unit, "minor": minor, "snaplen": snaplen, "link_type": link & 0xFFFF}


def records(data: bytes, max_packets: int) -> Iterator[tuple]:
    """``(index, offset, ts_ns, captured, original, bytes)`` of each record; old versions have the two lengths the other way round."""
    yield from records_after(parse_header(data), data, 24, 0, 0, max_packets)


def records_after(head: dict, data: bytes, at: int, before: int, index: int, max_packets: int, last: bool = True) -> Iterator[tuple]:
    """``records`` of ``data`` from byte ``at`` on, behind ``before`` bytes and ``index`` records of the file; where more follows (not ``last``) only whole ones."""
    limit = LINK_BYTES.get(head["link_type"], RECORD_BYTES)
    while at < len(data) and index < max_packets:
        if at + 16 > len(data):
            if not last:
                return
            raise CaptureError("truncated_record_header", f"record {index + 1} has no whole header")
        seconds, fraction, captured, original = struct.unpack_from(head["order"] + "IIII", data, at)
        if head["minor"] < 3 or head["minor"] == 3 and captured > original:
            captured, original = original, captured
        if captured > limit:
            raise CaptureError("unsafe_captured_length", f"record {index + 1} says {captured} bytes")
        if at + 16 + captured > len(data):
            if not last:
                return
            raise CaptureError("truncated_record_data", f"record {index + 1} ends early")
        index += 1
        known = fraction * head["unit"] < 1_000_000_000
        yield index, before + at, seconds * 1_000_000_000 + fraction * head["unit"] if known else None, captured, original, data[at + 16 : at + 16 + captured]
        at += 16 + captured


KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.string()]
NAMES = ["path", "packet_index", "file_offset", "ts_ns", "captured_length", "original_length", "data", "link_type", "snap_length", "state", "error"]


def _rows(max_packets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data, rows, error, head, index = content.as_buffer().to_pybytes(), [], None, {"link_type": None, "snaplen": None}, 0
                pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(KINDS)], NAMES)
                try:
                    head = parse_header(data)
                    end = 24
                    for index, at, ts, captured, original, body in records(data, max_packets):  # noqa: B007
                        rows.append((path, index, at, ts, captured, original, body, head["link_type"], head["snaplen"], None, None))
                        end = at + 16 + captured
                        if len(rows) == 4096:
                            yield pack(rows)
                            rows = []
                    # the end of the file counts before the limit
                    state = "complete" if end == len(data) else "packet_limit_reached"
                except CaptureError as e:
                    state, error = "failed", e.code
                # a last row without a packet tells how the file ended
                rows.append((path, None, None, None, None, None, None, head["link_type"], head["snaplen"], state, error))
                yield pack(rows)

    return run


class _Parts:
    """A file whose parts come one after the other. Of what came it keeps the record that isn't whole yet."""

    def __init__(self, path: str, max_packets: int):
        self.path, self.max_packets = path, max_packets
        self.head, self.data, self.before, self.index, self.error = None, b"", 0, 0, None

    def take(self, part: bytes, last: bool = False) -> list[tuple]:
        """Rows of the records that end in ``part``."""
        rows, used = [], 0
        if self.error:
            return rows
        self.data += part
        try:
            if self.head is None and (last or len(self.data) >= 24):
                self.head, used = parse_header(self.data), 24
            if self.head is not None:
                for index, at, ts, captured, original, body in records_after(self.head, self.data, used, self.before, self.index, self.max_packets, last):
                    rows.append((self.path, index, at, ts, captured, original, body, self.head["link_type"], self.head["snaplen"], None, None))
        except CaptureError as e:
            self.error, self.data = e.code, b""
        if rows:
            self.index, used = rows[-1][1], rows[-1][2] + 16 + rows[-1][4] - self.before
        self.data, self.before = self.data[used:], self.before + used
        if self.index >= self.max_packets:
            self.data = self.data[:1]  # what follows the limit isn't kept
        return rows

    def end(self) -> list[tuple]:
        """The records that are left, and the row that tells how the file ended."""
        rows = self.take(b"", last=True)
        state = "failed" if self.error else "packet_limit_reached" if self.data else "complete"
        head = self.head or {"link_type": None, "snaplen": None}
        return [*rows, (self.path, None, None, None, None, None, None, head["link_type"], head["snaplen"], state, self.error)]


def _rows_of_parts(max_packets: int):
    """Rows of ``NAMES`` of parts ``(path, content)`` in order, a file's side by side."""
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(KINDS)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if file is None or file.path != path:
                    if file is not None:
                        yield pack(file.end())
                    file = _Parts(path, max_packets)
                rows = file.take(content.as_buffer().to_pybytes())
                if rows:
                    yield pack(rows)
        if file is not None:
            yield pack(file.end())

    return run


SCHEMA = "path string, packet_index bigint, file_offset bigint, ts_ns bigint, captured_length bigint, original_length bigint, data binary, link_type int, snap_length bigint, state string, error string"


def refusal(path: Column, length: Column, max_bytes: int) -> Column:
    """The code of a file that isn't read, by its name and size; else null."""
    name = F.lower(path)
    wrong = F.when(name.endswith(".pcapng"), "pcapng_not_supported").when(~name.endswith(".pcap"), "unsupported_extension")
    return F.coalesce(wrong, F.when(length > max_bytes, "file_too_large"))


def read_contents(files: DataFrame, max_packets: int = 100_000, max_bytes: int = 512 << 20) -> DataFrame:
    """Rows of ``NAMES`` of files ``(path, length, content)``: one a packet, and one a file with ``state`` (complete, packet_limit_reached, failed) and
    ``error``. A file that is refused by name or size has that row alone, and its content isn't read."""
    told = files.withColumn("error", refusal(F.col("path"), F.col("length"), max_bytes))
    read = told.filter("error IS NULL").select("path", "content").mapInArrow(_rows(max_packets), SCHEMA)
    return _with_refused(read, told.filter("error IS NOT NULL"))


def read_parts(parts: DataFrame, max_packets: int = 100_000, max_bytes: int = 512 << 20) -> DataFrame:
    """``read_contents`` of files whose bytes come in parts ``(path, part, content)``, put together in order of ``part``; one task a file, which reads part
    after part."""
    sizes = parts.groupBy("path").agg(F.sum(F.octet_length("content")).alias("length"))
    told = sizes.withColumn("error", refusal(F.col("path"), F.col("length"), max_bytes))
    kept = parts.join(told.filter("error IS NULL").select("path"), "path", "left_semi").select("path", "part", "content")
    read = kept.repartition("path").sortWithinPartitions("path", "part").select("path", "content").mapInArrow(_rows_of_parts(max_packets), SCHEMA)
    return _with_refused(read, told.filter("error IS NOT NULL"))


def _with_refused(read: DataFrame, refused: DataFrame) -> DataFrame:
    null = {n: F.lit(None) for n in NAMES}
    refused = refused.select("path", "error").withColumns({n: c for n, c in null.items() if n not in ("path", "error")} | {"state": F.lit("failed")})
    types = dict(x.split() for x in SCHEMA.split(", "))
    return read.unionByName(refused.select(*[F.col(n).cast(types[n]).alias(n) for n in NAMES]))


def read_pcap(spark: SparkSession, paths: str | list[str], max_packets: int = 100_000, max_bytes: int = 512 << 20) -> DataFrame:
    """``read_contents`` of all files of the paths. Names end in .pcap; times with a fraction out of range are null."""
    return read_contents(spark.read.format("binaryFile").load(paths).select("path", "length", "content"), max_packets, max_bytes)


def capture_summary(rows: DataFrame) -> DataFrame:
    """One row per file: packets, bytes, first and last time, state and error."""
    return rows.groupBy("path").agg(F.count("packet_index").alias("packets"), F.coalesce(F.sum("captured_length"), F.lit(0)).alias("captured_bytes"), F.coalesce(F.sum("original_length"), F.lit(0)).alias("original_bytes"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.max("state").alias("state"), F.max("error").alias("error"))


def capture_warnings(rows: DataFrame) -> DataFrame:
    """``path, code, n, first_index`` of what is odd about packets: times out of order or range, and lengths that don't fit."""
    packets = rows.filter("packet_index IS NOT NULL")
    before = F.last("ts_ns", ignorenulls=True).over(Window.partitionBy("path").orderBy("packet_index").rowsBetween(Window.unboundedPreceding, -1))
    codes = F.array(
        F.when(F.col("ts_ns") < before, "out_of_order_timestamp"),
        F.when(F.col("ts_ns").isNull(), "invalid_timestamp_fraction"),
        F.when(F.col("captured_length") > F.col("original_length"), "captured_exceeds_original"),
        F.when(F.col("captured_length") > F.col("snap_length"), "captured_exceeds_snap_length"),
    )
    each = packets.select("path", "packet_index", codes.alias("codes")).select("path", "packet_index", F.explode(F.array_compact("codes")).alias("code"))
    return each.groupBy("path", "code").agg(F.count(F.lit(1)).alias("n"), F.min("packet_index").alias("first_index"))


def _little(value: Column, size: int) -> Column:
    big = hexed(value, size)
    return F.concat(*[F.substring(big, 2 * i + 1, 2) for i in reversed(range(size))])


def _record() -> Column:
    """A packet's record in hexadecimal, with microseconds."""
    seconds, part = F.floor(F.col("ts_ns") / 1_000_000_000), F.floor(F.pmod(F.col("ts_ns"), F.lit(1_000_000_000)) / 1000)
    return F.concat(_little(seconds, 4), _little(part, 4), _little(F.octet_length("data"), 4), _little(F.col("original_length"), 4), F.hex("data"))


def _header(snaplen: int, link_type: int) -> str:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, link_type).hex()


def as_pcap(packets: DataFrame, snaplen: int = 65_535, link_type: int = 1) -> DataFrame:
    """``path, content, sha256``: the file of each path's packets (``packet_index``, ``ts_ns``, ``original_length``, ``data``), with microseconds.

    A file is one value, so a path's packets are as many as a file may hold; ``as_parts`` has no such limit."""
    held = packets.select("path", F.struct("packet_index", _record().alias("record")).alias("r")).groupBy("path").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    content = F.unhex(F.concat(F.lit(_header(snaplen, link_type)), F.array_join(F.transform("rs", lambda r: r["record"]), "")))
    return held.select("path", content.alias("content")).withColumn("sha256", F.sha2("content", 256))


#: Packet indexes in a part of a file.
PART_PACKETS = 1024


def as_parts(packets: DataFrame, snaplen: int = 65_535, link_type: int = 1, span: int = PART_PACKETS) -> DataFrame:
    """``path, part, content``: the bytes of ``as_pcap`` in parts of ``span`` indexes, in order of ``part``, as a written table. The header is a file's part -1."""
    cut = packets.select("path", F.floor(F.col("packet_index") / span).alias("part"), F.struct("packet_index", _record().alias("record")).alias("r"))
    held = cut.groupBy("path", "part").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    bodies = materialize(held.select("path", "part", F.unhex(F.array_join(F.transform("rs", lambda r: r["record"]), "")).alias("content")), "capture-parts")
    heads = bodies.select("path").distinct().select("path", F.lit(-1).cast("bigint").alias("part"), F.unhex(F.lit(_header(snaplen, link_type))).alias("content"))
    return bodies.union(heads)
