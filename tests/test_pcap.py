"""pcap files and headers, built byte by byte."""

import struct

import pytest
from pyspark.sql import functions as F

from netloom.functions import headers
from netloom.sources import pcap

BASE = 1_767_225_600


def capture(records, order="<", magic=0xA1B2C3D4, version=(2, 4), snaplen=65_535, link=1):
    out = struct.pack(order + "IHHiIII", magic, *version, 0, 0, snaplen, link)
    for seconds, fraction, captured, original, data in records:
        out += struct.pack(order + "IIII", seconds, fraction, captured, original) + data
    return out


def three(order="<", magic=0xA1B2C3D4, **more):
    return capture([(BASE + i, 5, 4, 60, b"abcd") for i in range(3)], order, magic, **more)


FILES = {
    "le_us.pcap": (three(), ("complete", None, 3)),
    "be_us.pcap": (three(">"), ("complete", None, 3)),
    "le_ns.PCAP": (three(magic=0xA1B23C4D), ("complete", None, 3)),
    "be_ns.pcap": (three(">", 0xA1B23C4D), ("complete", None, 3)),
    "empty.pcap": (capture([]), ("complete", None, 0)),
    "short.pcap": (capture([])[:12], ("failed", "truncated_global_header", 0)),
    "magic.pcap": (b"nothing like a capture file", ("failed", "invalid_magic", 0)),
    "ng.pcap": (b"\x0a\x0d\x0d\x0a" + bytes(30), ("failed", "unsupported_format", 0)),
    "modified.pcap": (b"\x34\xcd\xb2\xa1" + bytes(30), ("failed", "unsupported_format", 0)),
    "version3.pcap": (three(version=(3, 0)), ("failed", "invalid_version", 0)),
    "version25.pcap": (three(version=(2, 5)), ("failed", "invalid_version", 0)),
    "snap0.pcap": (three(snaplen=0), ("failed", "invalid_snap_length", 0)),
    "reserved.pcap": (three(link=1 | 1 << 16), ("failed", "corrupt_global_header", 0)),
    "old.pcap": (capture([(BASE, 0, 79, 64, bytes(64))], version=(2, 2)), ("complete", None, 1)),
    "cut_header.pcap": (three()[:-12] + b"", ("failed", "truncated_record_header", 2)),
    "cut_data.pcap": (three()[:-2], ("failed", "truncated_record_data", 2)),
    "huge.pcap": (capture([(BASE, 0, 0xFFFFFFF0, 60, b"")]), ("failed", "unsafe_captured_length", 0)),
    "odd.pcap": (capture([(BASE + 9, 0, 70, 70, bytes(70)), (BASE, 0, 4, 60, b"abcd"), (BASE + 10, 2_000_000, 4, 2, b"abcd")], snaplen=64), ("complete", None, 3)),
}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    for name, (data, _) in FILES.items():
        (folder / name).write_bytes(data)
    (folder / "notes.txt").write_bytes(b"no capture")
    return pcap.read_pcap(spark, f"file://{folder}").cache()


def test_files_end_as_they_should(rows):
    found = {r["path"].rsplit("/", 1)[1]: (r["state"], r["error"], r["packets"]) for r in pcap.capture_summary(rows).collect()}
    refused = {"notes.txt": ("failed", "unsupported_extension", 0)}
    assert found == {name: wanted for name, (_, wanted) in FILES.items()} | refused


def test_refused_files_have_a_row(spark):
    files = spark.createDataFrame([(n, len(c), c) for n, c in (("a.PCAPNG", b""), ("b.pcap", three()), ("c.pcap", three() + bytes(999)), ("d", b""))], "path string, length bigint, content binary")
    found = {r["path"]: (r["state"], r["error"], r["packets"]) for r in pcap.capture_summary(pcap.read_contents(files, max_bytes=500)).collect()}
    assert found == {"a.PCAPNG": ("failed", "pcapng_not_supported", 0), "b.pcap": ("complete", None, 3), "c.pcap": ("failed", "file_too_large", 0), "d": ("failed", "unsupported_extension", 0)}


def test_lengths_times_and_warnings(spark, rows):
    of = lambda name: rows.filter(F.col("path").endswith("/" + name) & F.col("packet_index").isNotNull())
    assert [(r["captured_length"], r["original_length"]) for r in of("old.pcap").collect()] == [(64, 79)]
    assert [r["ts_ns"] for r in of("be_us.pcap").orderBy("packet_index").collect()] == [(BASE + i) * 10**9 + 5000 for i in range(3)]
    assert [r["ts_ns"] for r in of("le_ns.PCAP").orderBy("packet_index").collect()] == [(BASE + i) * 10**9 + 5 for i in range(3)]
    assert {(r["code"], r["n"], r["first_index"]) for r in pcap.capture_warnings(rows).filter("path LIKE '%odd.pcap'").collect()} == {("captured_exceeds_snap_length", 1, 1), ("out_of_order_timestamp", 1, 2), ("invalid_timestamp_fraction", 1, 3), ("captured_exceeds_original", 1, 3)}
    written = pcap.as_pcap(of("be_us.pcap")).collect()
    assert bytes(written[0]["content"]) == FILES["le_us.pcap"][0]


def test_packet_limit(spark, tmp_path):
    (tmp_path / "many.pcap").write_bytes(capture([(BASE, 0, 1, 1, b"x")] * 25))
    states = [pcap.capture_summary(pcap.read_pcap(spark, f"file://{tmp_path}", max_packets=n)).first() for n in (10, 25)]
    assert [(r["state"], r["packets"]) for r in states] == [("packet_limit_reached", 10), ("complete", 25)]


ETH = bytes.fromhex("020000000001020000000002")
V4 = bytes.fromhex("450000280001000040060000C0000201C0000202")
TCP = struct.pack(">HHIIHHHH", 1000, 443, 7, 0, 0x5000 | 0x112, 100, 0, 0)
V6 = bytes.fromhex("6000000000080040") + bytes.fromhex("20010db8000000000000000000000001") + bytes.fromhex("20010db8000000010000000000000002")
UDP = struct.pack(">HHHH", 53, 5353, 8, 0)


def v6(payload, following):
    return bytes.fromhex("60000000") + struct.pack(">HBB", len(payload), following, 64) + V6[8:] + payload


FRAMES = {
    "tcp": (ETH + b"\x08\x00" + V4 + TCP, None, ("complete", "192.0.2.1", 1000, 0x112, 0)),
    "one tag": (ETH + bytes.fromhex("81000001") + b"\x08\x00" + V4 + TCP, None, ("complete", "192.0.2.1", 1000, 0x112, 0)),
    "two tags": (ETH + bytes.fromhex("88a80001810000020800") + V4 + TCP, None, ("complete", "192.0.2.1", 1000, 0x112, 0)),
    "three tags": (ETH + bytes.fromhex("88a8000181000002910000030800") + V4 + TCP, None, ("unsupported", None, None, None, None)),
    "lldp": (ETH + b"\x88\xcc" + bytes(40), None, ("unsupported", None, None, None, None)),
    "802.3": (ETH + b"\x00\x20" + bytes(40), None, ("unsupported", None, None, None, None)),
    "odd type": (ETH + b"\x05\xf0" + bytes(40), None, ("malformed", None, None, None, None)),
    "gre": (ETH + b"\x08\x00" + V4[:9] + b"\x2f" + V4[10:] + bytes(20), None, ("unsupported", "192.0.2.1", None, None, None)),
    "cut": (ETH + b"\x08\x00" + V4 + TCP[:9], 54, ("truncated", "192.0.2.1", 1000, None, None)),
    "short": (ETH + b"\x08\x00" + V4 + TCP[:9], None, ("malformed", "192.0.2.1", 1000, None, None)),
    "no frame": (b"abc", None, ("malformed", None, None, None, None)),
    "udp6": (ETH + b"\x86\xdd" + v6(UDP, 17), None, ("complete", "2001:db8::1", 53, None, 0)),
    "extensions": (ETH + b"\x86\xdd" + v6(bytes([60, 0]) + bytes(6) + bytes([17, 0]) + bytes(6) + UDP, 0), None, ("complete", "2001:db8::1", 53, None, 0)),
    "later fragment": (ETH + b"\x86\xdd" + v6(bytes([17, 0, 0, 0x18]) + bytes(4) + b"datadata", 44), None, ("complete", "2001:db8::1", None, None, None)),
    "bad udp": (ETH + b"\x86\xdd" + v6(UDP[:4] + b"\x00\x07" + UDP[6:], 17), None, ("malformed", "2001:db8::1", 53, None, -1)),
}


def test_frames_are_decoded(spark):
    rows = [(i, bytearray(data), wire or len(data), 1) for i, (data, wire, _) in enumerate(FRAMES.values())]
    frames = spark.createDataFrame([*rows, (99, bytearray(ETH + bytes(40)), 54, 101)], "packet_index bigint, data binary, original_length bigint, link_type int")
    out = {r["packet_index"]: r for r in headers.decoded(frames).collect()}
    got = {name: tuple(out[i][c] for c in ("decode_status", "src_ip", "src_port", "tcp_flags", "payload_length")) for i, name in enumerate(FRAMES)}
    assert got == {name: wanted for name, (_, _, wanted) in FRAMES.items()}
    assert out[99]["decode_status"] == "unsupported" and "data" not in out[0].asDict()
    assert out[0]["checksum_ok"] is False


def test_addresses_as_text(spark):
    import ipaddress

    cases = ["::", "::1", "1::", "2001:db8::1", "2001:0:0:1::1", "1:0:0:2:0:0:3:4", "1:2:3:4:5:6:7:8", "0:1:0:1:0:1:0:1", "fe80::1:0:0:1"]
    df = spark.createDataFrame([(i, bytearray(ipaddress.ip_address(c).packed)) for i, c in enumerate(cases)], "i int, b binary")
    assert [r["t"] for r in df.select("i", headers.address_text(F.col("b")).alias("t")).orderBy("i").collect()] == [str(ipaddress.ip_address(c)) for c in cases]


def test_stream_equals_batch_and_drops_late_packets(spark, tmp_path):
    from datetime import datetime, timedelta

    from netloom.streaming import sessions

    start = datetime(2024, 1, 1)
    rows = [("a", 0), ("a", 50), ("b", 60), ("a", 200), ("a", 4000), ("b", 4001)]
    schema = "k string, at timestamp, original_length bigint"
    spark.createDataFrame([(k, start + timedelta(seconds=s), 10) for k, s in rows], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: sessions.idle_sessions(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), ["k"], "at", "60 seconds", "10 minutes")
    whole = sorted((r["k"], r["packets"]) for r in sessions.run_once(stream(), "complete", "whole").collect())
    assert whole == [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1)]
    closed = sorted((r["k"], r["packets"]) for r in sessions.run_once(stream(), "append", "closed").collect())
    assert closed == [("a", 1), ("a", 2), ("b", 1)]


def test_extension_headers_cut_anywhere_are_truncated(spark):
    """An IPv6 frame with hop-by-hop options and a fragment header before UDP, cut after every byte."""
    ip = bytes.fromhex("6000000000200040" + "20010db8" + "00" * 11 + "01" + "20010db8" + "00" * 11 + "02")
    frame = bytes.fromhex("020000000001020000000002" + "86dd") + ip + bytes.fromhex("2c00010400000000" + "1100000100000007" + "0035003500100000" + "0102030405060708")
    rows = [(n, bytearray(frame[:n]), len(frame), 1) for n in range(len(frame) + 1)]
    frames = spark.createDataFrame(rows, "packet_index bigint, data binary, original_length bigint, link_type int")
    out = {r["packet_index"]: (r["decode_status"], r["dst_port"]) for r in headers.decoded(frames).collect()}
    assert {n: s for n, (s, _) in out.items()} == {n: "truncated" if n < 14 + 40 + 16 + 8 else "complete" for n in out}
    assert out[len(frame)][1] == 53
    counts = {r["decode_status"]: (r["packets"], r["first_index"]) for r in headers.status_counts(headers.decoded(frames)).collect()}
    assert counts == {"truncated": (78, 0), "complete": (9, 78)}


def test_files_in_parts_give_what_whole_files_give(spark):
    rows = [("a.pcap", i, i * 1_000_000_007_000, 60 + i, bytes([i]) * (40 + i % 5)) for i in range(1, 60)] + [("b.pcap", 3, 5_000, 10, b"x" * 10)]
    packets = spark.createDataFrame(rows, "path string, packet_index bigint, ts_ns bigint, original_length bigint, data binary")
    parts = pcap.as_parts(packets, span=7)
    assert parts.groupBy("path").count().collect() and max(len(r["content"]) for r in parts.collect()) < 7 * (16 + 45)
    whole = pcap.as_pcap(packets)
    for name, content in [(r["path"], bytes(r["content"])) for r in whole.collect()]:
        assert b"".join(bytes(r["content"]) for r in parts.filter(parts["path"] == name).orderBy("part").collect()) == content
    # cut anywhere, also within headers, and with limits
    data = bytes(whole.filter("path = 'a.pcap'").first()["content"])
    files = {f"{size}-{left}.pcap": (data[: len(data) - left], size) for size in (5, 24, 61, 1000) for left in (0, 3, 50, len(data) - 10)} | {"wrong.pcap": (b"abcd" + data, 9), "x.txt": (data, 100)}
    pieces = [(p, k, d[a : a + n]) for p, (d, n) in files.items() for k, a in enumerate(range(0, len(d), n))]
    given = spark.createDataFrame(pieces, "path string, part bigint, content binary")
    contents = spark.createDataFrame([(p, len(d), d) for p, (d, _) in files.items()], "path string, length bigint, content binary")
    for limit in (10**9, 12):
        got, wanted = pcap.read_parts(given, limit), pcap.read_contents(contents, limit)
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
