"""Queries of detection rules and of the alerts' table. Their SQL counts every window by a plain self-join."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import predicates as p
from netloom.operators import detect, lists, rules
from netloom.plans.catalog import FLOWS, query
from netloom.plans.flow_queries import WIRE
from netloom.sources import views
from netloom.stored import materialize

DAY = 86_400_000_000_000
WIDTH, PACKET_WIDTH = 400 * DAY, 3 * DAY

HOSTS = FLOWS.replace("flows AS (SELECT ", "flows AS (SELECT CAST(1000 + l_partkey % 300 * 7 AS INTEGER) AS initiator_port, epoch_us(l_shipdate) * 1000 + CAST(l_quantity AS BIGINT) * 1000000000 AS last_seen_ns, ") + """, h0 AS (SELECT *, initiator % 40 AS src, responder % 10 AS dst, CASE WHEN state = 'syn_sent' THEN 0 ELSE 1 END AS back_packets FROM flows),
 hosts AS (SELECT *, protocol = 6 AND (state = 'syn_sent' OR (state = 'reset' AND bytes_back = 0)) AS failed, responder_port <> 0 AS ported, back_packets > 0 AND NOT (protocol = 6 AND (state = 'syn_sent' OR (state = 'reset' AND bytes_back = 0))) AS answered FROM h0)"""


def window_sql(rows: str, key: str, counted: str, width: int, threshold: int, shown: str, ts: str, order: str, last: str, newest: bool, fact: str) -> str:
    """Alerts of a windowed rule over the table ``rows``: count every window by a self-join, find the first crossing, and cite."""
    keys = key.split(", ")
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    mine = ", ".join(f"a.{k}" for k in keys)
    sign = "DESC" if newest else "ASC"
    return f"""seen AS (SELECT {mine}, a.{ts} AS t, a.{order} AS i, {counted} AS n FROM {rows} a JOIN {rows} b ON {same("a", "b")} AND b.{ts} BETWEEN a.{ts} - {width} AND a.{ts} AND (b.{ts} < a.{ts} OR b.{order} <= a.{order}) GROUP BY {mine}, a.{ts}, a.{order}),
 crossed AS (SELECT {key}, min((t, i)) FILTER (n >= {threshold}) AS c, max(n) AS peak FROM seen GROUP BY {key} HAVING max(n) >= {threshold}),
 bear AS (SELECT r.*, c.peak, (r.{ts}, r.{order}) > c.c AS later FROM {rows} r JOIN crossed c ON {same("r", "c")} WHERE (r.{ts}, r.{order}) > c.c OR r.{ts} >= c.c[1] - {width}),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY {key}, later ORDER BY CASE WHEN later THEN {ts} END, CASE WHEN later THEN {order} END, {ts} {sign}, {order} {sign}) AS r, least(50, count(*) FILTER (NOT later) OVER (PARTITION BY {key})) AS held FROM bear),
 cites AS (SELECT *, CASE WHEN later THEN held + r <= 50 ELSE r <= 50 END AS shown FROM ranked)
 SELECT {shown}, CASE WHEN any_value(peak) >= {2 * threshold} THEN 'high' ELSE 'medium' END AS confidence, min({ts}) AS first_seen_ns, max({last}) AS last_seen_ns, string_agg(CAST({order} AS VARCHAR), ',' ORDER BY later, {ts}, {order}) FILTER (shown) AS related,
 '{fact}=' || any_value(peak) || ';threshold={threshold};window_s={width // 1_000_000_000}' AS evidence FROM cites WHERE shown OR later GROUP BY {key}"""


def shown(alerts):
    facts = F.array_join(F.transform("evidence", lambda e: F.concat(e["name"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")
    return alerts.select("source", "destination", "destination_port", "confidence", "first_seen_ns", "last_seen_ns", F.array_join("related", ",").alias("related"), facts.alias("evidence"))


FOUR = detect.scan_rules(WIDTH, 12, 25, 2, 150)
PACKET_THREE = detect.packet_rules(PACKET_WIDTH, 3, 2, 2)
NO = "CAST(NULL AS VARCHAR) AS destination, CAST(NULL AS INTEGER) AS destination_port"


def flow_alerts(spark, d, k, hosts=None):
    return rules.window_alerts(views.host_flows(spark, d) if hosts is None else hosts, FOUR[k], "first_seen_ns", "flow_id", "last_seen_ns")


def packet_alerts(spark, d, k):
    # every event counts, however late after the one before it; whole captures (analysis_queries) go by the rule's clock
    return rules.window_alerts(views.wire(spark, d), PACKET_THREE[k], "ts_ns", "packet_index", newest=False, by_clock=False)


@query(f"WITH {HOSTS}, f AS (SELECT * FROM hosts WHERE failed), {window_sql('f', 'src, dst', 'count(DISTINCT b.responder_port)', WIDTH, 12, 'CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS destination, CAST(NULL AS INTEGER) AS destination_port', 'first_seen_ns', 'flow_id', 'last_seen_ns', True, 'distinct_ports_unanswered_or_refused')}")
def r1_scan_syn(spark, d):
    return shown(flow_alerts(spark, d, 0))


@query(f"WITH {HOSTS}, f AS (SELECT * FROM hosts WHERE ported), {window_sql('f', 'src, dst', 'count(DISTINCT (b.protocol, b.responder_port))', WIDTH, 25, 'CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS destination, CAST(NULL AS INTEGER) AS destination_port', 'first_seen_ns', 'flow_id', 'last_seen_ns', True, 'distinct_destination_ports')}")
def r2_scan_ports(spark, d):
    return shown(flow_alerts(spark, d, 1))


@query(f"WITH {HOSTS}, f AS (SELECT * FROM hosts WHERE ported AND NOT answered), {window_sql('f', 'src, protocol, responder_port', 'count(DISTINCT b.dst)', WIDTH, 2, 'CAST(src AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS destination, responder_port AS destination_port', 'first_seen_ns', 'flow_id', 'last_seen_ns', True, 'distinct_hosts_unanswered_or_refused')}")
def r3_scan_hosts(spark, d):
    return shown(flow_alerts(spark, d, 2))


@query(f"WITH {HOSTS}, f AS (SELECT * FROM hosts WHERE failed), {window_sql('f', 'src', 'count(*)', WIDTH, 150, f'CAST(src AS VARCHAR) AS source, {NO}', 'first_seen_ns', 'flow_id', 'last_seen_ns', True, 'failed_connection_attempts')}")
def r4_tcp_fail(spark, d):
    return shown(flow_alerts(spark, d, 3))


@query(f"""WITH {HOSTS}, g AS (SELECT *, row_number() OVER w AS r, CASE WHEN lag(first_seen_ns) OVER w IS NOT NULL THEN greatest(first_seen_ns / 1e9 - lag(first_seen_ns / 1e9) OVER w, 0) END AS gap FROM hosts WHERE ported WINDOW w AS (PARTITION BY src, dst, protocol, responder_port ORDER BY first_seen_ns, flow_id))
 SELECT CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS destination, responder_port AS destination_port, CASE WHEN count(*) >= 6 AND stddev_pop(gap) / avg(gap) <= 0.4 THEN 'high' ELSE 'medium' END AS confidence, min(first_seen_ns) AS first_seen_ns, max(last_seen_ns) AS last_seen_ns,
 string_agg(CAST(flow_id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 50) AS related, count(*) AS connections, round(stddev_pop(gap) / avg(gap), 6) AS jitter FROM g GROUP BY src, dst, protocol, responder_port HAVING count(*) >= 3 AND avg(gap) >= 10 AND stddev_pop(gap) / avg(gap) <= 0.8""")
def r5_beacons(spark, d):
    found = detect.beacons(views.host_flows(spark, d), 3, 10.0, 0.8)
    n = F.element_at("evidence", 1)["value"].cast("bigint")
    mean, stddev = F.element_at("evidence", 2)["value"].cast("double"), F.element_at("evidence", 3)["value"].cast("double")
    return found.select("source", "destination", "destination_port", "confidence", "first_seen_ns", "last_seen_ns", F.array_join("related", ",").alias("related"), n.alias("connections"), F.round(stddev / mean, 6).alias("jitter"))


@query(f"""WITH {HOSTS}, u AS (SELECT *, row_number() OVER (PARTITION BY protocol, responder_port ORDER BY first_seen_ns, flow_id) AS r FROM hosts WHERE ported)
 SELECT CAST(arg_min(src, r) AS VARCHAR) AS source, CAST(arg_min(dst, r) AS VARCHAR) AS destination, responder_port AS destination_port, 'low' AS confidence, min(first_seen_ns) AS first_seen_ns, max(last_seen_ns) AS last_seen_ns, string_agg(CAST(flow_id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 50) AS related,
 'flows_to_port=' || count(*) || ';protocol=' || CASE protocol WHEN 6 THEN 'TCP' ELSE 'UDP' END || ';flows_in_capture=' || (SELECT count(*) FROM hosts WHERE ported) AS evidence FROM u GROUP BY protocol, responder_port
 HAVING count(*) <= 20 AND responder_port NOT IN (20, 21, 22, 23, 25, 53, 67, 68, 80, 110, 123, 143, 161, 389, 443, 445, 465, 587, 636, 993, 995, 3389, 5353, 8080) AND responder_port < 49152 AND bool_and(protocol = 6 OR initiator_port >= 1024 AND initiator_port NOT IN (3389, 5353, 8080)) AND bool_or(answered) AND (SELECT count(*) FROM hosts WHERE ported) >= 50""")
def r6_rare_ports(spark, d):
    return shown(detect.rare_ports(views.host_flows(spark, d), 50, 20))


@query(f"""WITH {HOSTS}, o AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY first_seen_ns, flow_id) AS r, CASE WHEN bytes_back > 0 THEN CAST(bytes_out AS DOUBLE) / bytes_back END AS ratio FROM hosts WHERE src < 30 AND dst >= 5 AND bytes_out >= 1000000 AND (bytes_back = 0 OR CAST(bytes_out AS DOUBLE) / bytes_back >= 1500))
 SELECT CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS destination, CAST(NULL AS INTEGER) AS destination_port, CASE WHEN sum(bytes_out) >= 10000000 THEN 'high' ELSE 'medium' END AS confidence, min(first_seen_ns) AS first_seen_ns, max(last_seen_ns) AS last_seen_ns,
 string_agg(CAST(flow_id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 50) AS related, 'bytes_sent=' || CAST(sum(bytes_out) AS BIGINT) || ';bytes_received=' || CAST(sum(bytes_back) AS BIGINT) || ';flows=' || count(*) || ';lowest_flow_ratio=' || coalesce(CAST(round(min(ratio), 1) AS VARCHAR), 'no reply bytes') AS evidence FROM o GROUP BY src, dst""")
def r7_outbound_ratio(spark, d):
    return shown(detect.outbound_ratio(views.host_flows(spark, d), 1_000_000, 1500, F.col("src") < 30, F.col("dst") >= 5))


@query(f"""WITH {HOSTS}, c AS (SELECT *, row_number() OVER (PARTITION BY src, dst, responder_port ORDER BY first_seen_ns, flow_id) AS r FROM hosts WHERE protocol = 6 AND answered AND responder_port IN (21, 23, 110, 143, 513, 514))
 SELECT CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS destination, responder_port AS destination_port, 'medium' AS confidence, min(first_seen_ns) AS first_seen_ns, max(last_seen_ns) AS last_seen_ns, string_agg(CAST(flow_id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 50) AS related,
 'destination_port=' || responder_port || ';connections=' || count(*) AS evidence FROM c GROUP BY src, dst, responder_port""")
def r8_cleartext(spark, d):
    return shown(detect.cleartext(views.host_flows(spark, d)))


@query(f"WITH {WIRE}, f AS (SELECT * FROM wire WHERE dns_query IS NOT NULL AND NOT dns_response), {window_sql('f', 'src_ip', 'count(*)', PACKET_WIDTH, 3, f'src_ip AS source, {NO}', 'ts_ns', 'packet_index', 'ts_ns', False, 'queries_in_window')}")
def r9_dns_volume(spark, d):
    return shown(packet_alerts(spark, d, 0))


@query(f"WITH {WIRE}, f AS (SELECT * FROM wire WHERE sender_ip <> '0.0.0.0'), {window_sql('f', 'sender_ip', 'count(DISTINCT b.sender_mac)', PACKET_WIDTH, 2, f'sender_ip AS source, {NO}', 'ts_ns', 'packet_index', 'ts_ns', False, 'mac_addresses_in_window')}")
def r11_arp_conflict(spark, d):
    return shown(packet_alerts(spark, d, 1))


@query(f"WITH {WIRE}, f AS (SELECT * FROM wire WHERE gratuitous AND sender_ip <> '0.0.0.0'), {window_sql('f', 'sender_mac', 'count(*)', PACKET_WIDTH, 2, f'sender_mac AS source, {NO}', 'ts_ns', 'packet_index', 'ts_ns', False, 'gratuitous_arp_in_window')}")
def r12_arp_gratuitous(spark, d):
    return shown(packet_alerts(spark, d, 2))


QUESTIONS = f"""{WIRE}, q0 AS (SELECT *, string_split(rtrim(lower(dns_query), '.'), '.') AS labels FROM wire WHERE dns_query IS NOT NULL AND NOT dns_response),
 q1 AS (SELECT packet_index, ts_ns, src_ip, dns_query, record_type, array_to_string(labels[len(labels) - 1 :], '.') AS parent, labels[: len(labels) - 2] AS rest, array_to_string(labels[: len(labels) - 2], '.') AS sub FROM q0 WHERE len(labels) >= 3),
 letters AS (SELECT packet_index, label, c, count(*) AS n FROM (SELECT packet_index, label, unnest(string_split(label, '')) AS c FROM (SELECT packet_index, unnest(rest) AS label FROM q1)) GROUP BY ALL),
 bits AS (SELECT packet_index, label, -sum(n / CAST(length(label) AS DOUBLE) * log2(n / CAST(length(label) AS DOUBLE))) AS entropy FROM letters GROUP BY packet_index, label),
 q AS (SELECT q1.*, coalesce(len(list_filter(rest, lambda x: length(x) >= 20)) > 0 OR length(dns_query) >= 100 OR record_type IN (10, 16) OR (SELECT bool_or(length(label) >= 16 AND entropy >= 3.4) FROM bits b WHERE b.packet_index = q1.packet_index), false) AS suspicious FROM q1)"""


@query(f"WITH {QUESTIONS} SELECT packet_index, parent, sub, suspicious FROM q")
def u3_suspicious_names(spark, d):
    asked = views.wire(spark, d).filter("dns_query IS NOT NULL AND NOT dns_response")
    parent, sub = rules.split_name(F.col("dns_query"))
    return asked.select("packet_index", parent.alias("parent"), sub.alias("sub"), detect.suspicious_name(F.col("dns_query"), F.col("record_type"), 20, 100, 3.4).alias("suspicious")).filter("parent IS NOT NULL")


@query(f"""WITH {QUESTIONS}, s AS (SELECT a.src_ip, a.parent, a.ts_ns, a.packet_index, a.suspicious, CASE WHEN a.suspicious THEN count(*) FILTER (b.suspicious) ELSE 0 END AS n, count(DISTINCT b.sub) AS subs FROM q a JOIN q b ON a.src_ip = b.src_ip AND a.parent = b.parent AND b.ts_ns BETWEEN a.ts_ns - {20 * DAY} AND a.ts_ns GROUP BY a.src_ip, a.parent, a.ts_ns, a.packet_index, a.suspicious),
 c AS (SELECT src_ip, parent, min(packet_index) AS crossed, arg_min(ts_ns, packet_index) AS t, arg_min(n >= 3, packet_index) AS by_count, arg_min(subs >= 4 AND n > 0, packet_index) AS by_spread FROM s WHERE n >= 3 OR (subs >= 4 AND n > 0) GROUP BY ALL),
 pk AS (SELECT s.src_ip, s.parent, max(n) AS peak, max(subs) AS spread, max(s.ts_ns) AS last_ns FROM s JOIN c ON s.src_ip = c.src_ip AND s.parent = c.parent WHERE packet_index >= crossed GROUP BY ALL),
 b AS (SELECT q.*, row_number() OVER (PARTITION BY q.src_ip, q.parent ORDER BY packet_index) AS r FROM q JOIN c ON q.src_ip = c.src_ip AND q.parent = c.parent WHERE packet_index >= crossed OR (suspicious AND ts_ns >= t - {20 * DAY}))
 SELECT b.src_ip || ' ' || b.parent AS source, {NO}, CASE WHEN any_value(by_count) AND any_value(by_spread) THEN 'high' ELSE 'medium' END AS confidence, min(ts_ns) FILTER (r <= 50) AS first_seen_ns, any_value(last_ns) AS last_seen_ns, string_agg(CAST(packet_index AS VARCHAR), ',' ORDER BY r) FILTER (r <= 50) AS related,
 'parent_domain=' || b.parent || ';suspicious_queries_in_window=' || any_value(peak) || ';distinct_subdomains_in_window=' || any_value(spread) || ';threshold_reached=' || CASE WHEN any_value(by_count) AND any_value(by_spread) THEN 'both' WHEN any_value(by_spread) THEN 'min_distinct_subdomains' ELSE 'min_suspicious_queries' END AS evidence
 FROM b JOIN c ON b.src_ip = c.src_ip AND b.parent = c.parent JOIN pk ON b.src_ip = pk.src_ip AND b.parent = pk.parent GROUP BY b.src_ip, b.parent""")
def r10_dns_tunnel(spark, d):
    return shown(detect.dns_tunnels(views.wire(spark, d), 20 * DAY, 3, 4, by_clock=False, label=20, whole=100, bits=3.4))


THREE_SQL = f"""{HOSTS}, base AS (
 SELECT 'scan_hosts' AS rule, 'medium' AS severity, 2 AS position, * FROM (WITH f AS (SELECT * FROM hosts WHERE ported AND NOT answered), {window_sql('f', 'src, protocol, responder_port', 'count(DISTINCT b.dst)', WIDTH, 2, 'CAST(src AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS destination, responder_port AS destination_port', 'first_seen_ns', 'flow_id', 'last_seen_ns', True, 'x')})
 UNION ALL SELECT 'rare_port', 'low', 5, source, destination, destination_port, confidence, first_seen_ns, last_seen_ns, related, '' FROM (WITH u AS (SELECT *, row_number() OVER (PARTITION BY protocol, responder_port ORDER BY first_seen_ns, flow_id) AS r FROM hosts WHERE ported)
  SELECT CAST(arg_min(src, r) AS VARCHAR) AS source, CAST(arg_min(dst, r) AS VARCHAR) AS destination, responder_port AS destination_port, 'low' AS confidence, min(first_seen_ns) AS first_seen_ns, max(last_seen_ns) AS last_seen_ns, string_agg(CAST(flow_id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 50) AS related FROM u GROUP BY protocol, responder_port
  HAVING count(*) <= 20 AND responder_port NOT IN (20, 21, 22, 23, 25, 53, 67, 68, 80, 110, 123, 143, 161, 389, 443, 445, 465, 587, 636, 993, 995, 3389, 5353, 8080) AND responder_port < 49152 AND bool_and(protocol = 6 OR initiator_port >= 1024 AND initiator_port NOT IN (3389, 5353, 8080)) AND bool_or(answered))
 UNION ALL SELECT 'cleartext', 'low', 7, CAST(src AS VARCHAR), CAST(dst AS VARCHAR), responder_port, 'medium', min(first_seen_ns), max(last_seen_ns), string_agg(CAST(flow_id AS VARCHAR), ',' ORDER BY first_seen_ns, flow_id), '' FROM hosts WHERE protocol = 6 AND answered AND responder_port IN (21, 23, 110, 143, 513, 514) GROUP BY src, dst, responder_port),
 capped AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY first_seen_ns, source, destination, destination_port) AS r FROM base), alerts AS (SELECT *, row_number() OVER (ORDER BY position, r) AS alert_id FROM capped WHERE r <= 1000),
 cites AS (SELECT alert_id, severity, CAST(unnest(string_split(related, ',')) AS BIGINT) AS flow_id FROM alerts),
 links AS (SELECT flow_id, string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY alert_id) FILTER (r <= 16) AS alert_ids, least(count(*), 16) AS alert_count, arg_max(severity, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS max_severity FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY alert_id) AS r FROM cites) GROUP BY flow_id)"""


def stored_hosts(spark, d):
    return materialize(views.host_flows(spark, d), "hosts")


def three_alerts(spark, d, hosts=None):
    hosts = stored_hosts(spark, d) if hosts is None else hosts
    alerts = rules.numbered([flow_alerts(spark, d, 2, hosts), detect.rare_ports(hosts, 50, 20), detect.cleartext(hosts)])
    return materialize(rules.with_citations(alerts), "alerts")


@query(f"WITH {THREE_SQL} SELECT CAST(alert_id AS INTEGER) AS alert_id, rule, severity, confidence, source, destination, destination_port, first_seen_ns FROM alerts")
def u8_numbered_alerts(spark, d):
    return three_alerts(spark, d).select("alert_id", "rule", "severity", "confidence", "source", "destination", "destination_port", "first_seen_ns")


@query(f"WITH {THREE_SQL} SELECT h.flow_id, alert_ids, CAST(alert_count AS INTEGER) AS alert_count, max_severity FROM hosts h JOIN links l ON h.flow_id = l.flow_id")
def u10_u11_flows_with_alerts(spark, d):
    hosts = stored_hosts(spark, d)
    linked = rules.with_alerts(hosts.select("flow_id"), three_alerts(spark, d, hosts)).filter("alert_count > 0")
    return linked.select("flow_id", F.array_join("alert_ids", ",").alias("alert_ids"), "alert_count", "max_severity")


@query(f"WITH {THREE_SQL} SELECT rule, severity, count(*) AS alerts, count(*) FILTER (confidence = 'high') AS high_confidence FROM alerts GROUP BY rule, severity")
def u12_detection_summary(spark, d):
    return rules.summary(three_alerts(spark, d))


@query(f"""WITH {THREE_SQL}, a AS (SELECT *, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM alerts) SELECT sort, place, CAST(alert_id AS INTEGER) AS alert_id FROM (
 SELECT 'number' AS sort, row_number() OVER (ORDER BY alert_id) AS place, alert_id FROM a UNION ALL SELECT 'severity', row_number() OVER (ORDER BY rank DESC, alert_id), alert_id FROM a UNION ALL SELECT 'newest', row_number() OVER (ORDER BY first_seen_ns DESC, alert_id), alert_id FROM a) WHERE place <= 20""")
def q5_alert_sorts(spark, d):
    alerts = three_alerts(spark, d).withColumn("severity_rank", lists.severity_rank(F.col("severity")))
    return lists.labelled_pages({by: lists.page(lists.sorted_by(alerts, lists.ALERT_SORTS, by), 1, 20).select("alert_id") for by in lists.ALERT_SORTS})


@query(f"WITH {THREE_SQL} SELECT CAST(alert_id AS INTEGER) AS alert_id, rule, confidence FROM alerts WHERE severity = 'low' AND rule = 'rare_port' ORDER BY alert_id LIMIT 25 OFFSET 25")
def q10_list_alerts(spark, d):
    found = lists.equal_to(three_alerts(spark, d), severity="low", rule="rare_port", source=None)
    return lists.page(lists.sorted_by(found, lists.ALERT_SORTS, "number"), 2, 25).select("alert_id", "rule", "confidence")


@query(f"WITH {THREE_SQL} SELECT CAST(alert_id AS INTEGER) AS alert_id, CASE WHEN alert_id = 3 THEN 'acknowledged' ELSE 'open' END AS status FROM alerts")
def q13_alert_status(spark, d):
    return lists.with_status(three_alerts(spark, d).select("alert_id", F.lit("open").alias("status")), 3, "acknowledged")
