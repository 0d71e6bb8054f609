"""Queries of stored lists and files: captures written and read again, deep pages, and addresses against a table of networks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from netloom.functions import headers, networks
from netloom.operators import lists, store
from netloom.plans.catalog import query
from netloom.plans.flow_queries import WIRE
from netloom.sources import pcap, views
from netloom.stored import shared_dir

_FRAMES = f"""{WIRE}, frames AS (SELECT packet_index, ts_ns // 1000 * 1000 AS ts_ns, 'c' || packet_index % 3 || '.pcap' AS path, 14 + CASE WHEN src_ip IS NULL THEN 28 ELSE CASE WHEN src_key LIKE '6%' THEN 40 + CASE WHEN fragment THEN 8 ELSE 0 END ELSE 20 END + CASE WHEN fragment THEN 16 WHEN protocol = 6 THEN 20 + payload_length ELSE 8 + payload_length END END AS n FROM wire),
 placed AS (SELECT path, row_number() OVER w AS packet_index, 24 + CAST(coalesce(sum(n + 16) OVER (PARTITION BY path ORDER BY packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset, ts_ns, n FROM frames WINDOW w AS (PARTITION BY path ORDER BY packet_index)),
 files AS (SELECT * FROM placed UNION ALL SELECT 'cut.pcap', packet_index, file_offset, ts_ns, n FROM placed WHERE path = 'c0.pcap' AND packet_index < (SELECT max(packet_index) FROM placed WHERE path = 'c0.pcap'))"""


def files(spark, d):
    """Three captures of the wire's frames in parts, one of them cut short, and others that are refused."""
    wire = views.wire(spark, d).select("packet_index", "ts_ns")
    frames = headers.ethernet_frame(views.wire(spark, d)).join(wire, "packet_index").withColumn("path", F.concat(F.lit("c"), (F.col("packet_index") % 3).cast("string"), F.lit(".pcap")))
    whole = pcap.as_parts(frames)
    first = whole.filter("path = 'c0.pcap'")
    end = first.agg(F.max("part")).scalar()
    cut = first.select(F.lit("cut.pcap").alias("path"), "part", F.when(F.col("part") == end, F.expr("substring(content, 1, length(content) - 5)")).otherwise(F.col("content")).alias("content"))
    others = whole.filter("path = 'c1.pcap'").select(F.explode(F.array(F.lit("notes.txt"), F.lit("next.pcapng"))).alias("path"), "part", "content")
    return whole.union(cut).union(others)


@query(f"WITH {_FRAMES} SELECT path, packet_index, file_offset, ts_ns, CAST(n AS BIGINT) AS captured_length, CAST(n AS BIGINT) AS original_length FROM files")
def s1_s4_records_of_files(spark, d):
    rows = pcap.read_parts(files(spark, d), max_packets=10**9, max_bytes=1 << 40)
    return rows.filter("packet_index IS NOT NULL").select("path", "packet_index", "file_offset", "ts_ns", "captured_length", "original_length")


@query(f"""WITH {_FRAMES} SELECT path, count(*) AS packets, CAST(sum(n) AS BIGINT) AS captured_bytes, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, CASE path WHEN 'cut.pcap' THEN 'failed' ELSE 'complete' END AS state, CASE path WHEN 'cut.pcap' THEN 'truncated_record_data' END AS error FROM files GROUP BY path
 UNION ALL SELECT 'notes.txt', 0, 0, NULL, NULL, 'failed', 'unsupported_extension' UNION ALL SELECT 'next.pcapng', 0, 0, NULL, NULL, 'failed', 'pcapng_not_supported'""")
def s5_s12_capture_summaries(spark, d):
    return pcap.capture_summary(pcap.read_parts(files(spark, d), max_packets=10**9, max_bytes=1 << 40)).select("path", "packets", "captured_bytes", "first_ns", "last_ns", "state", "error")


@query(f"WITH {WIRE}, n AS (SELECT count(*) // 50 - 1 AS number FROM wire) SELECT packet_index, wire_length AS original_length FROM (SELECT packet_index, CASE WHEN arp THEN NULL ELSE wire_length END AS wire_length FROM wire) ORDER BY wire_length DESC NULLS LAST, packet_index LIMIT 50 OFFSET (SELECT (number - 1) * 50 FROM n)")
def q1_deep_page(spark, d):
    """The last page but one of all packets, longest first, without sorting those before it."""
    packets = views.wire(spark, d).select("packet_index", "original_length")
    index = lists.page_index(packets, lists.PACKET_SORTS, "length", 16)
    return index.page(sum(index.counts) // 50 - 1, 50)


_NETWORKS = "nets AS (SELECT 'n' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN '6' || '20010db80000000000000000000000' || lpad(to_hex(s_suppkey % 16), 2, '0') ELSE '4' || '0a0000' || lpad(lower(to_hex(s_suppkey % 256)), 2, '0') END AS base, CASE WHEN s_suppkey % 3 = 0 THEN 96 + s_suppkey % 9 * 4 ELSE 16 + s_suppkey % 5 * 4 END AS length FROM supplier)"


@query(f"""WITH {WIRE}, {_NETWORKS}, a AS (SELECT DISTINCT src_key FROM wire WHERE src_ip IS NOT NULL),
 m AS (SELECT src_key, name, row_number() OVER (PARTITION BY src_key ORDER BY length DESC, name) AS r FROM a JOIN nets ON left(src_key, 1 + length // 4) = left(base, 1 + length // 4) AND len(src_key) = len(base))
 SELECT packet_index, name AS network FROM wire LEFT JOIN m ON wire.src_key = m.src_key AND r = 1""")
def u6_table_of_networks(spark, d):
    """Every packet's source in the longest of a table of networks of both families."""
    key = F.col("s_suppkey")
    six = F.concat(F.lit("20010DB80000000000000000000000"), F.lpad(F.hex(key % 16), 2, "0"))
    four = F.concat(F.lit("0A0000"), F.lpad(F.hex(key % 256), 2, "0"))
    table = views.table(spark, d, "supplier").select(F.concat(F.lit("n"), key.cast("string")).alias("name"), F.unhex(F.when(key % 3 == 0, six).otherwise(four)).alias("base"), F.when(key % 3 == 0, 96 + key % 9 * 4).otherwise(16 + key % 5 * 4).alias("length"))
    return networks.with_network(views.wire(spark, d), "src_bin", table).select("packet_index", "network")


_STORED = f"""{WIRE}, p AS (SELECT packet_index % 7 AS session_id, * FROM wire), s AS (SELECT session_id, max(ts_ns) AS last_ns, count(*) AS packets FROM p GROUP BY session_id),
 a AS (SELECT session_id, packet_index AS alert_id, CASE WHEN session_id = 3 AND packet_index = (SELECT min(packet_index) FROM p WHERE session_id = 3 AND arp) THEN 'closed' ELSE 'open' END AS status FROM p WHERE arp),
 f AS (SELECT session_id, src_ip, dst_ip FROM p WHERE src_ip IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {_STORED} SELECT 'sessions' AS name, session_id, count(*) AS n, CAST(sum(packets) AS BIGINT) AS checked FROM s WHERE session_id <> 2 GROUP BY session_id
 UNION ALL SELECT 'packets', session_id, count(*), CAST(sum(packet_index) AS BIGINT) FROM p WHERE session_id <> 2 GROUP BY session_id UNION ALL SELECT 'flows', session_id, count(*), count(DISTINCT src_ip) FROM f WHERE session_id <> 2 GROUP BY session_id
 UNION ALL SELECT 'alerts', session_id, count(*), count(*) FILTER (status = 'open') FROM a WHERE session_id <> 2 GROUP BY session_id""")
def q13_q14_stored_changes(spark, d):
    """A store of seven sessions of which one is deleted with all that belongs to it, and an alert of another one is closed."""
    wire = views.wire(spark, d).withColumn("session_id", (F.col("packet_index") % 7).cast("int"))
    held = store.Store(spark, f"{shared_dir(spark)}/netloom-store-{uuid.uuid4().hex}")
    held.put("packets", wire.select("session_id", "packet_index", "ts_ns", "src_ip", "dst_ip", F.col("sender_mac").isNotNull().alias("arp")))
    packets = held.read("packets")
    held.put("sessions", packets.groupBy("session_id").agg(F.max("ts_ns").alias("last_ns"), F.count(F.lit(1)).alias("packets")))
    held.put("flows", packets.filter("src_ip IS NOT NULL").select("session_id", "src_ip", "dst_ip").distinct())
    held.put("alerts", packets.filter("arp").select("session_id", F.col("packet_index").alias("alert_id"), F.lit("open").alias("status")))
    held.delete_sessions([2])
    first = held.session("alerts", 3).agg(F.min("alert_id")).first()[0]
    held.set_alert_status(3, first, "closed")
    checks = {"sessions": F.sum("packets"), "packets": F.sum("packet_index"), "flows": F.count_distinct("src_ip"), "alerts": F.count_if(F.col("status") == "open")}
    rows = [held.read(t).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), c.cast("bigint").alias("checked")).select(F.lit(t).alias("name"), F.col("session_id").cast("bigint").alias("session_id"), "n", "checked") for t, c in checks.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])
