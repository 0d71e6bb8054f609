"""All queries of the library outside ``llm``, with SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import predicates as p
from netloom.operators import flows, lists, windows
from netloom.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86_400_000_000_000

PACKETS = """packets AS (SELECT event_id + 1 AS packet_index, epoch_us(ts) * 1000 AS ts_ns, user_id AS src, CAST(json_extract_string(props, '$.k') AS INTEGER) AS dst_port,
 CASE event_type WHEN 'view' THEN 17 WHEN 'signup' THEN 1 ELSE 6 END AS protocol, CAST(floor(value * 100) AS BIGINT) AS original_length,
 CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 16 WHEN 'error' THEN 4 ELSE 0 END AS tcp_flags FROM events)"""
FLOWS = """flows AS (SELECT l_orderkey * 8 + l_linenumber AS flow_id, o_custkey AS initiator, l_suppkey AS responder, CAST(l_partkey % 1000 AS INTEGER) AS responder_port,
 CASE WHEN l_linestatus = 'O' THEN 6 ELSE 17 END AS protocol, CAST(floor(l_extendedprice * 100) AS BIGINT) AS bytes_out, CAST(floor(l_tax * l_extendedprice) AS BIGINT) AS bytes_back,
 epoch_us(l_shipdate) * 1000 AS first_seen_ns, CASE l_returnflag WHEN 'R' THEN 'reset' WHEN 'A' THEN 'established' ELSE 'syn_sent' END AS state FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {FLOWS} SELECT flow_id, initiator, responder, bytes_out, state FROM flows WHERE bytes_out > 50000 AND protocol = 6 ORDER BY bytes_out DESC, flow_id LIMIT 50 OFFSET 50")
def q7_list_flows(spark, d):
    wanted = p.compare(p.LINE_FIELDS, "flow.bytes", ">", 50_000) & p.present(p.LINE_FIELDS, "tcp")
    # every line has its order, so a page is cut before the join
    top = lists.page(views.flow_lines(spark, d).filter(wanted).orderBy(F.desc("bytes_out"), "flow_id"), 2, 50)
    return views.with_initiator(spark, d, top).orderBy(F.desc("bytes_out"), "flow_id").select("flow_id", "initiator", "responder", "bytes_out", "state")


@query(f"WITH {PACKETS} SELECT packet_index, src, dst_port FROM packets WHERE protocol = 6 AND (tcp_flags & 2) <> 0 AND dst_port <> 40 AND NOT (src = 7)")
def f8_packet_filter(spark, d):
    wanted = p.present(p.EVENT_FIELDS, "tcp.flags.syn") & p.compare(p.EVENT_FIELDS, "port", "!=", 40) & p.negate(p.compare(p.EVENT_FIELDS, "ip.src", "==", 7))
    return views.packets(spark, d).filter(wanted).select("packet_index", "src", "dst_port")


@query(f"WITH {FLOWS} SELECT count(*) AS n FROM flows WHERE (initiator = 12 OR responder = 12) AND lower(state) LIKE '%set%'")
def f10_either_side(spark, d):
    wanted = p.compare(p.LINE_FIELDS, "flow.addr", "==", 12) & p.compare(p.LINE_FIELDS, "flow.state", "contains", "SET")
    return views.flows(spark, d).filter(wanted).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PACKETS} SELECT packet_index, count(*) OVER (PARTITION BY src ORDER BY ts_ns RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS n FROM packets")
def t1_sliding_count(spark, d):
    return windows.sliding_count(views.packets(spark, d), ["src"], "ts_ns", DAY, "packet_index").select("packet_index", "n")


@query(f"""WITH {PACKETS}, w AS (SELECT *, count(DISTINCT dst_port) OVER (PARTITION BY src ORDER BY ts_ns RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW) AS n FROM packets),
 f AS (SELECT src, min(packet_index) AS first_index FROM w WHERE n >= 12 GROUP BY src)
 SELECT w.src, f.first_index, max(n) AS peak, count(*) FILTER (packet_index >= first_index) AS rows_after FROM w JOIN f ON w.src = f.src GROUP BY w.src, f.first_index""")
def t9_distinct_crossing(spark, d):
    packets = views.packets(spark, d)
    seen = windows.sliding_distinct(packets, ["src"], "ts_ns", "dst_port", 3 * DAY, "packet_index")
    found = windows.crossings(seen, ["src"], "ts_ns", "packet_index", "n_distinct", 12)
    later = packets.join(found, "src").filter("packet_index >= crossed").groupBy("src").agg(F.count(F.lit(1)).alias("rows_after"))
    return found.join(later, "src").select("src", F.col("crossed").alias("first_index"), "peak", "rows_after")


SESSIONS = f"""{PACKETS}, c AS (SELECT *, max(ts_ns) OVER (ORDER BY packet_index) AS clock FROM packets),
 g AS (SELECT *, CASE WHEN clock - lag(clock) OVER (PARTITION BY src ORDER BY packet_index) > {DAY // 2} THEN 1 ELSE 0 END AS fresh FROM c),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY packet_index) AS session FROM g)"""


@query(f"""WITH {SESSIONS}, b AS (SELECT *, max(ts_ns) OVER (PARTITION BY src, session ORDER BY packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM s)
 SELECT src, CAST(session AS BIGINT) AS session, count(*) AS packets, CAST(sum(original_length) AS BIGINT) AS bytes, min(original_length) AS size_min, max(original_length) AS size_max,
 round(avg(original_length), 4) AS size_mean, round(stddev_pop(original_length), 4) AS size_stddev, max(CASE WHEN earlier IS NOT NULL THEN greatest(ts_ns - earlier, 0) END) AS gap_max, min(CASE WHEN earlier IS NOT NULL THEN greatest(ts_ns - earlier, 0) END) AS gap_min, round(avg(CASE WHEN earlier IS NOT NULL THEN greatest(ts_ns - earlier, 0) / 1e9 END), 4) AS gap_mean, min(packet_index) AS first_packet,
 round((max(ts_ns) - min(ts_ns)) / 1e9, 6) AS duration_s FROM b GROUP BY src, session""")
def w4_w13_sessions(spark, d):
    clocked = flows.with_clock(views.packets(spark, d))
    stats = flows.session_statistics(flows.sessionize(clocked, ["src"], DAY // 2), ["src"])
    return stats.select("src", "session", "packets", "bytes", "size_min", "size_max", F.round("size_mean", 4).alias("size_mean"), F.round("size_stddev", 4).alias("size_stddev"), "gap_max", "gap_min", F.round(F.col("gap_mean") / 1e9, 4).alias("gap_mean"), "first_packet", F.round("duration_s", 6).alias("duration_s"))


@query(f"""WITH {FLOWS} SELECT dominant, count(*) AS n FROM (SELECT CASE WHEN bytes_out * 100 > (bytes_out + bytes_back) * 55 THEN 'initiator' WHEN bytes_back * 100 > (bytes_out + bytes_back) * 55 THEN 'responder' ELSE 'balanced' END AS dominant FROM flows) GROUP BY dominant""")
def w20_dominant_side(spark, d):
    side = flows.dominant_side(F.col("bytes_out"), F.col("bytes_back"))
    return views.flow_lines(spark, d).groupBy(side.alias("dominant")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PACKETS}, names AS (SELECT src, ts_ns AS told, max(dst_port) AS port FROM packets WHERE protocol = 17 GROUP BY src, ts_ns)
 SELECT packet_index, port FROM (SELECT * FROM packets WHERE protocol = 6) e ASOF LEFT JOIN names n ON e.src = n.src AND e.ts_ns >= n.told""")
def w19_asof_names(spark, d):
    packets = views.packets(spark, d)
    told = packets.filter("protocol = 17").groupBy("src", F.col("ts_ns").alias("told")).agg(F.max("dst_port").alias("port"))
    return flows.latest_before(packets.filter("protocol = 6"), told, "src", "ts_ns", "told", "port").select("packet_index", "port")


@query(f"""WITH {FLOWS}, r AS (SELECT state, flow_id, first_seen_ns, row_number() OVER (PARTITION BY state ORDER BY first_seen_ns, flow_id) AS rank FROM flows) SELECT state, flow_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 100""")
def u7_capped_groups(spark, d):
    first = F.row_number().over(Window.partitionBy("state").orderBy("first_seen_ns", "flow_id"))
    return views.flow_lines(spark, d).select("state", "flow_id", first.alias("rank")).filter("rank <= 100")


@query(f"WITH {PACKETS} SELECT protocol, tcp_flags, count(*) AS n, min(packet_index) AS first_index, CAST(sum(original_length) AS BIGINT) AS bytes FROM packets GROUP BY protocol, tcp_flags")
def d25_summary(spark, d):
    return views.packets(spark, d).groupBy("protocol", "tcp_flags").agg(F.count(F.lit(1)).alias("n"), F.min("packet_index").alias("first_index"), F.sum("original_length").alias("bytes"))


@query("SELECT c_custkey, c_name, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) JOIN customer ON o_custkey = c_custkey WHERE r <= 3")
def a4_newest_sessions(spark, d):
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    kept = views.table(spark, d, "orders").withColumn("r", newest).filter("r <= 3")
    return kept.join(views.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "o_orderkey")
