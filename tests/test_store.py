"""Stored changes touch their own files alone; deep pages, and addresses in a table of networks, against plain Python."""

import hashlib
import ipaddress
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from netloom.functions import networks
from netloom.operators import lists, store


def digests(folder):
    return {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.parquet")}


def test_changes_leave_other_files_as_they_are(spark, tmp_path):
    held = store.Store(spark, f"file://{tmp_path}")
    for table in store.TABLES:
        rows = [(s, s * 10 + k, "open", 1000 * s) for s in range(4) for k in range(3)]
        held.put(table, spark.createDataFrame(rows, "session_id int, alert_id bigint, status string, at bigint"))
    before = digests(tmp_path)
    assert held.set_alert_status(2, 21, "closed") == 1
    after = digests(tmp_path)
    assert {k for k in before if after.get(k) != before[k]} == {k for k in before if k.startswith("alerts/session_id=2/")}
    assert {r["alert_id"]: r["status"] for r in held.session("alerts", 2).collect()} == {20: "open", 21: "closed", 22: "open"}
    # again, of an alert that isn't there, and of a session that isn't there: nothing is written
    assert held.set_alert_status(2, 21, "closed") == held.set_alert_status(2, 99, "closed") == held.set_alert_status(9, 21, "closed") == 0
    assert digests(tmp_path) == after
    with pytest.raises(ValueError, match="no status"):
        held.set_alert_status(2, 21, "forgotten")
    for _ in range(2):
        held.delete_sessions([1])
        left = digests(tmp_path)
        assert left == {k: v for k, v in after.items() if "/session_id=1/" not in k}
    held.put("flows", spark.createDataFrame([(3, 1, "open", 5)], "session_id int, alert_id bigint, status string, at bigint"))
    assert held.session("flows", 3).count() == 1 and held.read("flows").count() == 7
    sessions = held.read("sessions").groupBy("session_id").agg(F.timestamp_seconds(F.max("at") * 86.4).alias("seen"))
    held.put("sessions", sessions)
    assert held.purge("seen", F.timestamp_seconds(F.lit(3 * 86_400)), 2) == [0]
    assert {r["session_id"] for r in held.read("packets").select("session_id").distinct().collect()} == {2, 3}


def test_deep_pages_equal_a_sorted_list(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, 3, 4, 5])) for i in range(500)]
    table = spark.createDataFrame(rows, "packet_index bigint, original_length bigint")
    wanted = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    for ranges in (1, 7):
        index = lists.page_index(table, lists.PACKET_SORTS, "length", ranges)
        for number, size in ((1, 50), (3, 70), (7, 70), (8, 70), (9, 70), (500, 1), (1, 500)):
            assert [r["packet_index"] for r in index.page(number, size).collect()] == wanted[(number - 1) * size : number * size], (ranges, number, size)
    assert lists.page_index(table.filter("false"), lists.PACKET_SORTS, "length", 4).page(2, 10).count() == 0
    with pytest.raises(ValueError, match="pages"):
        index.page(0, 5)


def test_longest_network_wins(spark):
    rng = random.Random(9)
    nets = [(f"n{i}", ipaddress.ip_network((rng.randrange(1 << 32), rng.choice([0, 1, 8, 15, 24, 31, 32])), strict=False)) for i in range(60)]
    nets += [(f"m{i}", ipaddress.ip_network((rng.randrange(1 << 128), rng.choice([0, 3, 63, 64, 65, 127, 128])), strict=False)) for i in range(60)]
    addresses = [n.network_address + rng.randrange(min(n.num_addresses, 1 << 60)) for _, n in nets] + [ipaddress.ip_address(rng.randrange(1 << 32)) for _ in range(40)]
    table = spark.createDataFrame([(k, bytearray(n.network_address.packed), n.prefixlen) for k, n in nets] + [("bad", bytearray(b"abc"), 3), ("long", bytearray(4), 40)], "name string, base binary, length int")
    rows = spark.createDataFrame([(i, bytearray(a.packed)) for i, a in enumerate(addresses)] + [(-1, None), (-2, bytearray(b"12345"))], "i int, address binary")

    def plain(a):
        held = [(-n.prefixlen, k) for k, n in nets if n.version == a.version and a in n]
        return min(held)[1] if held else None

    got = {r["i"]: r["network"] for r in networks.with_network(rows, "address", table).collect()}
    assert got == {i: plain(a) for i, a in enumerate(addresses)} | {-1: None, -2: None}
    assert networks.with_network(rows, "address", table.filter("false")).filter("network IS NULL").count() == len(addresses) + 2
