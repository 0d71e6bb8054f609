"""Further queries of the library outside ``llm``: name parts, flow numbers, flags and medians."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.operators import rules, windows
from netloom.plans.catalog import DAY, PACKETS, query
from netloom.sources import views

@query("""WITH h AS (SELECT page_id, string_split(rtrim(lower(regexp_extract(url, '://([^/?#]*)', 1)), '.'), '.') AS l FROM pages)
 SELECT page_id, CASE WHEN len(l) >= 3 THEN array_to_string(l[len(l) - 1 :], '.') END AS parent, CASE WHEN len(l) >= 3 THEN array_to_string(l[: len(l) - 2], '.') END AS rest FROM h""")
def u2_split_name(spark, d):
    parent, rest = rules.split_name(F.regexp_extract("url", "://([^/?#]*)", 1))
    return views.table(spark, d, "pages").select("page_id", parent.alias("parent"), rest.alias("rest"))


@query(f"WITH {PACKETS}, s AS (SELECT src, min(packet_index) AS first_packet FROM packets GROUP BY src) SELECT src, first_packet, row_number() OVER (ORDER BY first_packet) AS flow_number FROM s")
def w21_flow_numbers(spark, d):
    starts = views.packets(spark, d).groupBy("src").agg(F.min("packet_index").alias("first_packet"))
    return rules.flow_numbers(starts, "first_packet", "__range").select("src", "first_packet", "flow_number")


@query(f"WITH {PACKETS} SELECT src, CAST(bit_or(tcp_flags) AS INTEGER) AS flags, count(*) FILTER (tcp_flags & 2 <> 0) AS syn, count(*) FILTER (tcp_flags & 4 <> 0) AS rst FROM packets WHERE protocol = 6 GROUP BY src")
def w16_flag_unions(spark, d):
    tcp = views.packets(spark, d).filter("protocol = 6")
    return tcp.groupBy("src").agg(F.bit_or("tcp_flags").cast("int").alias("flags"), F.count_if(F.expr("tcp_flags & 2 <> 0")).alias("syn"), F.count_if(F.expr("tcp_flags & 4 <> 0")).alias("rst"))


@query(f"""WITH {PACKETS}, r AS (SELECT src, original_length, row_number() OVER (PARTITION BY src ORDER BY packet_index) AS place FROM packets)
 SELECT src, median(original_length) FILTER (place <= 256) AS size_median, count(*) <= 256 AS exact FROM r GROUP BY src""")
def w11_bounded_median(spark, d):
    # the window drops rows beyond the 256th in each task before anything is shuffled; counts are pre-aggregated
    packets = views.packets(spark, d)
    place = F.row_number().over(Window.partitionBy("src").orderBy("packet_index"))
    medians = packets.withColumn("place", place).filter("place <= 256").groupBy("src").agg(F.median("original_length").alias("size_median"))
    counts = packets.groupBy("src").agg((F.count(F.lit(1)) <= 256).alias("exact"))
    return medians.join(counts, "src")


@query(f"WITH {PACKETS}, l AS (SELECT *, least(ts_ns, coalesce(lag(ts_ns) OVER (PARTITION BY src ORDER BY packet_index), ts_ns)) AS two FROM packets) SELECT packet_index, max(two) OVER (PARTITION BY src ORDER BY packet_index) AS clock FROM l")
def t4_confirmed_clock(spark, d):
    return windows.confirmed_clock(views.packets(spark, d), ["src"], "ts_ns", "packet_index").select("packet_index", "clock")


@query(f"""WITH {PACKETS}, a AS (SELECT p.src, p.packet_index, p.ts_ns, count(DISTINCT q.dst_port) AS n FROM packets p JOIN packets q ON p.src = q.src AND q.ts_ns BETWEEN p.ts_ns - {3 * DAY} AND p.ts_ns GROUP BY ALL), c AS (SELECT src, min(packet_index) AS crossed, arg_min(ts_ns, packet_index) AS t FROM a WHERE n >= 12 GROUP BY src),
 b AS (SELECT p.*, crossed, row_number() OVER (PARTITION BY p.src ORDER BY p.packet_index) AS r FROM packets p JOIN c ON p.src = c.src WHERE p.ts_ns >= t - {3 * DAY}) SELECT src, string_agg(CAST(packet_index AS VARCHAR), ',' ORDER BY packet_index) AS cited FROM b WHERE r <= 50 GROUP BY src""")
def t2_earliest_of_a_crossing(spark, d):
    packets = views.packets(spark, d)
    seen = windows.sliding_distinct(packets, ["src"], "ts_ns", "dst_port", 3 * DAY, "packet_index")
    found = windows.crossings(seen, ["src"], "ts_ns", "packet_index", "n_distinct", 12)
    shown = windows.cited(packets, found, ["src"], "ts_ns", "packet_index", 3 * DAY, newest=False)
    return shown.select("src", F.array_join(F.transform("related", lambda x: x.cast("string")), ",").alias("cited"))


@query(f"""WITH {PACKETS}, a AS (SELECT p.src, p.packet_index, p.ts_ns, count(DISTINCT q.dst_port) AS n FROM packets p JOIN packets q ON p.src = q.src AND q.ts_ns BETWEEN p.ts_ns - {3 * DAY} AND p.ts_ns GROUP BY ALL), c AS (SELECT src, min(packet_index) AS crossed, arg_min(ts_ns, packet_index) AS t FROM a WHERE n >= 12 GROUP BY src),
 v AS (SELECT DISTINCT p.src, dst_port FROM packets p JOIN c ON p.src = c.src AND p.packet_index <= crossed AND p.ts_ns >= t - {3 * DAY}), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst_port) AS r FROM v)
 SELECT src, string_agg(CAST(dst_port AS VARCHAR), ',' ORDER BY dst_port) FILTER (r <= 8) AS listed, greatest(count(*) - 8, 0) AS more FROM r GROUP BY src""")
def t3_values_at_crossing(spark, d):
    packets = views.packets(spark, d)
    seen = windows.sliding_distinct(packets, ["src"], "ts_ns", "dst_port", 3 * DAY, "packet_index")
    found = windows.crossings(seen, ["src"], "ts_ns", "packet_index", "n_distinct", 12)
    out = windows.values_at_crossing(packets, found, ["src"], "ts_ns", "packet_index", "dst_port", 3 * DAY)
    return out.select("src", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("listed"), "more")


@query(f"WITH {PACKETS}, l AS (SELECT *, least(ts_ns, coalesce(lag(ts_ns) OVER (PARTITION BY src ORDER BY packet_index), ts_ns)) AS two FROM packets), k AS (SELECT *, max(two) OVER (PARTITION BY src ORDER BY packet_index) AS clock FROM l) SELECT src, count(*) FILTER (ts_ns > clock + {DAY // 2}) AS dropped FROM k GROUP BY src")
def t5_far_future(spark, d):
    rows = windows.within_reach(views.packets(spark, d), ["src"], "ts_ns", "packet_index", DAY // 2)
    return rows.groupBy("src").agg(F.count_if(~F.col("evaluated")).alias("dropped"))
