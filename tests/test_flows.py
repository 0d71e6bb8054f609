"""Flows of a small capture, hot keys cut into ranges, and windows against plain counting."""

import random

from pyspark.sql import functions as F

from netloom.operators import clock, flows, rules, windows

S = 1_000_000_000
BASE = 1_767_225_600 * S
SCHEMA = "packet_index bigint, ts_ns bigint, src_ip string, dst_ip string, src_bin binary, dst_bin binary, src_port int, dst_port int, protocol int, tcp_flags int, seq int, payload_length int, original_length int, fragment boolean, dns_query string"


def packet(i, at, src, dst, protocol, flags=None, payload=0, seq=0, dns=None):
    address = lambda host: bytes([192, 0, 2, host]) if host < 100 else bytes(15) + bytes([host])
    return (i, BASE + round(at * S), str(src[0]), str(dst[0]), address(src[0]), address(dst[0]), src[1], dst[1], protocol, flags, seq, payload, payload + 54, False, dns)


def capture(spark):
    """DNS, a whole TCP connection with a repeated segment, a refused one, UDP out of order, ARP, and a UDP key used again after a pause."""
    dns, web, six = ((10, 5000), (53, 53)), ((10, 6000), (80, 443)), ((110, 7000), (111, 9))
    rows = [(0.0, *dns, 17, None, 30, 0, "www.example.com"), (0.02, *dns[::-1], 17, None, 50, 0, "www.example.com")]
    rows += [(0.1, *web, 6, 2), (0.13, *web[::-1], 6, 18), (0.131, *web, 6, 16), (0.132, *web, 6, 24, 200, 7), (0.1325, *web, 6, 24, 200, 7), (0.17, *web[::-1], 6, 24, 300, 9), (0.3, *web, 6, 17), (0.31, *web[::-1], 6, 17), (0.311, *web, 6, 16)]
    rows += [(0.4, (10, 6001), (80, 8080), 6, 2), (0.401, (80, 8080), (10, 6001), 6, 20), (0.5, *six, 17), (0.499, *six, 17)]
    udp = ((10, 7001), (90, 99))
    later = [(1.0, *udp, 17), (2.0, *udp, 17), (92.0, *udp, 17)]
    rows = [packet(i + 1, *r) for i, r in enumerate(rows)]
    arp = (len(rows) + 1, BASE + 600_000_000, *[None] * 10, 42, False, None)
    rows += [arp, *[packet(len(rows) + 2 + i, *r) for i, r in enumerate(later)]]
    return spark.createDataFrame(rows, SCHEMA)


def records(spark, packets, span=1 << 20):
    table = clock.clocked(packets)
    flowed = flows.flows_of(table, span=span).cache()
    done = flows.end_reasons(flows.flow_records(flowed), flows.tcp_summary(flowed).select("first_packet", "tcp_state"), flows.epoch_ends(table))
    return flowed, {r["first_packet"]: r for r in done.collect()}


def test_flows_of_a_capture(spark):
    packets = capture(spark)
    flowed, found = records(spark, packets)
    assert sorted(found) == [1, 3, 12, 14, 17, 19]
    assert [found[k]["end_reason"] for k in sorted(found)] == ["idle_timeout", "tcp_finished", "tcp_finished", "idle_timeout", "idle_timeout", "capture_end"]
    web = found[3]
    assert (web["basis"], web["tcp_state"], web["packets_initiator"], web["packets_responder"], web["initiator_port"]) == ("tcp_syn", "closed", 6, 3, 6000)
    assert found[12]["tcp_state"] == "reset" and found[1]["tcp_state"] is None and found[17]["packets_total"] == 2 and found[19]["packets_total"] == 1
    assert {r["first_packet"]: r["duplicates"] for r in flows.repeated_segments(flowed).collect()}[3] == 1
    late = {r["first_packet"]: r["late"] for r in flows.arrival_gaps(flowed).groupBy("first_packet").agg(F.count_if("out_of_order").alias("late")).collect()}
    assert late[14] == 1 and sum(late.values()) == 1
    assert {r["first_packet"]: r["values"] for r in flows.first_values(flowed, F.col("dns_query")).collect()} == {1: "www.example.com"}
    answers = spark.createDataFrame([("www.example.com", "80", 2), ("late.example.com", "80", 4)], "name string, ip string, at bigint")
    starts = flows.flow_records(flowed).select("first_packet", "responder_ip")
    assert {r["first_packet"]: r["names"] for r in flows.names_at_start(starts, answers).collect()} == {3: "www.example.com", 12: "www.example.com,late.example.com"}
    spans = flows.flow_records(flowed)
    assert flows.peak_active(spans, "first_seen_ns", "last_seen_ns").first()["peak"] == 1


def test_medians_are_of_all_sizes(spark):
    """A flow whose sizes grow after its 256th packet, one of two packets, one of a single one and one without sizes."""
    rows = [(1, i + 1, 60 if i < 256 else 60 + i) for i in range(700)] + [(1001, 1001, 60), (1001, 1002, 71), (1003, 1003, 90), (1004, 1004, None)]
    flowed = spark.createDataFrame(rows, "first_packet bigint, packet_index bigint, original_length int").repartition(8)
    medians = lambda **limit: {r["first_packet"]: (r["size_median"], r["exact"]) for r in flows.size_medians(flowed, **limit).collect()}
    assert medians() == {1: (409.5, True), 1001: (65.5, True), 1003: (90.0, True), 1004: (None, True)}
    assert medians(limit=256) == {1: (60.0, False), 1001: (65.5, True), 1003: (90.0, True), 1004: (None, True)}


def test_ranges_change_nothing(spark):
    """One key holds all rows, cut into ranges of three packets: the same flows, sessions and gaps as uncut."""
    rng = random.Random(3)
    a, b, rows, at = (10, 5000), (80, 443), [], 0.0
    for i in range(80):
        at += rng.choice([0.1, 1, 11, 301])
        src, dst = rng.choice([(a, b), (b, a)])
        rows.append(packet(i + 1, at, src, dst, 6, rng.choice([2, 16, 17, 4, 18]), rng.choice([0, 10]), rng.choice([1, 2])))
    packets = spark.createDataFrame(rows, SCHEMA)
    built = {span: records(spark, packets, span) for span in (3, 1 << 20)}
    for look in (
        lambda span: [(k, tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)) for k, r in sorted(built[span][1].items())],
        lambda span: sorted((r["first_packet"], r["duplicates"]) for r in flows.repeated_segments(built[span][0], span).collect()),
        lambda span: sorted((r["packet_index"], r["gap_s"]) for r in flows.arrival_gaps(built[span][0], span).select("packet_index", F.coalesce("gap_s", F.lit(-1.0)).alias("gap_s")).collect()),
        lambda span: sorted((r["packet_index"], r["session"]) for r in flows.sessionize(flows.with_clock(packets), ["protocol"], 10 * S, span=span).collect()),
    ):
        assert look(3) == look(1 << 20)


def test_windows_equal_counting(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.randrange(60), rng.randrange(5)) for i in range(150)]
    table = spark.createDataFrame(rows, "id bigint, k string, t bigint, v int")
    before = lambda r: [x for x in rows if x[1] == r[1] and r[2] - 7 <= x[2] <= r[2] and (x[2], x[0]) <= (r[2], r[0])]
    counts = {r["id"]: r["n"] for r in windows.sliding_count(table, ["k"], "t", 7, "id").collect()}
    distinct = {r["id"]: r["n_distinct"] for r in windows.sliding_distinct(table, ["k"], "t", "v", 7, "id").collect()}
    assert counts == {r[0]: len(before(r)) for r in rows}
    assert distinct == {r[0]: len({x[3] for x in before(r)}) for r in rows}


def test_confirmed_clock_ignores_one_wrong_time(spark):
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate([10, 20, 9000, 30, 40])], "id bigint, k int, t bigint")
    assert [r["clock"] for r in windows.confirmed_clock(rows, ["k"], "t", "id").orderBy("id").collect()] == [10, 10, 20, 30, 30]


def flow(i, at, src=1, dst=2, port=80, state="reset", **more):
    return {"flow_id": i, "first_seen_ns": at * S, "last_seen_ns": at * S, "src": src, "dst": dst, "protocol": 6, "initiator_port": 5000, "responder_port": port, "port_of_protocol": port, "basis": "tcp_syn", "state": state, "payload": 0, "back_packets": 1, "bytes_out": 10, "bytes_back": 0} | more


def test_scans_beacons_and_their_benign_likes(spark):
    from netloom.operators import detect

    four = {r.rule: r for r in detect.scan_rules(60 * S, 20, 50, 20, 30)}
    table = lambda rows: spark.createDataFrame(rows)
    alerts = lambda rows, rule: rules.window_alerts(table(rows), four[rule], "first_seen_ns", "flow_id", "last_seen_ns").collect()
    scan = [flow(i, 0, port=i + 1) for i in range(25)]
    found = alerts(scan, "scan_syn")
    assert len(found) == 1 and found[0]["source"] == "1" and found[0]["related"] == list(range(25)) and found[0]["confidence"] == "medium"
    assert alerts(scan[:15], "scan_syn") == [] and alerts([f | {"state": "established", "payload": 9} for f in scan], "scan_syn") == []
    assert alerts([f | {"payload": 5} for f in scan], "scan_syn") == []
    hosts = [flow(i, i, dst=i + 10, port=22) for i in range(25)]
    found = alerts(hosts, "scan_hosts")
    assert len(found) == 1 and found[0]["destination_port"] == 22 and alerts(hosts[:10], "scan_hosts") == []
    assert len(alerts([flow(i, i // 10, state="syn_sent") for i in range(65)], "tcp_fail")) == 1
    assert alerts([flow(i, i // 10, state="syn_sent") for i in range(65)], "tcp_fail")[0]["confidence"] == "high"
    steady = [flow(i, 60 * i + i % 2, state="established") for i in range(12)]
    assert [r["confidence"] for r in detect.beacons(table(steady), 6, 10.0, 0.1).collect()] == ["high"]
    assert detect.beacons(table([flow(i, i * i * 20) for i in range(12)]), 6, 10.0, 0.1).count() == 0
    rare = [flow(i, i, port=80, state="established", payload=1) for i in range(60)] + [flow(99, 99, port=4444, state="established", payload=1)]
    assert [r["destination_port"] for r in detect.rare_ports(table(rare), 50, 1).collect()] == [4444]
    assert detect.rare_ports(table(rare[-11:]), 50, 1).count() == 0
    sent = [flow(i, i, bytes_out=1_400_000, bytes_back=10) for i in range(8)]
    inside = lambda c: F.col(c) < 5
    assert detect.outbound_ratio(table(sent), 1_000_000, 10, inside("src"), ~inside("dst")).count() == 0
    assert [r["confidence"] for r in detect.outbound_ratio(table([f | {"dst": 9} for f in sent]), 1_000_000, 10, inside("src"), ~inside("dst")).collect()] == ["high"]
