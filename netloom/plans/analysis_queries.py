"""Whole captures: wire to flows to twelve rules to numbered alerts to flows with alerts; and the clock where times are wrong."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import analysis, clock, flows
from netloom.plans import alert_queries
from netloom.plans.alert_queries import DAY, QUESTIONS, window_sql
from netloom.plans.catalog import ORACLE_SQL, query
from netloom.plans.flow_queries import ENDS, LINGER, OTHER_IDLE, TCP_IDLE, WALK, WIRE
from netloom.sources import views

WIDTH, PACKET_WIDTH, TUNNEL_WIDTH = 10 * DAY, 3 * DAY, 20 * DAY
# thresholds that fit the test tables
SETTINGS = analysis.Settings(
    TCP_IDLE, OTHER_IDLE, LINGER, 10 * DAY, WIDTH, PACKET_WIDTH, TUNNEL_WIDTH, syn_ports=1, any_ports=2, hosts=2, failures=2, beacon=(3, 10.0, 0.8), rare=(50, 20), outbound=(300, 1.5),
    cleartext_ports=[80], queries=3, tunnel=(3, 4), names={"label": 20, "whole": 100, "bits": 3.4}, addresses=2, gratuitous=2,
)

NO_PORT, NO_END = "CAST(NULL AS INTEGER) AS destination_port", "CAST(NULL AS VARCHAR) AS destination, CAST(NULL AS INTEGER) AS destination_port"


def _clocked(rows: str, width: int) -> str:
    """Rows of a packet rule that its clock lets in."""
    return f"f AS (SELECT * FROM (SELECT *, max(two) OVER (ORDER BY packet_index) AS clk FROM (SELECT *, least(ts_ns, coalesce(lag(ts_ns) OVER (ORDER BY packet_index), ts_ns)) AS two FROM wire WHERE {rows})) WHERE ts_ns <= clk + {width})"


def _evaluated(rows: str, width: int) -> str:
    return f"SELECT ts_ns <= max(two) OVER (ORDER BY packet_index) + {width} AS let_in FROM (SELECT packet_index, ts_ns, least(ts_ns, coalesce(lag(ts_ns) OVER (ORDER BY packet_index), ts_ns)) AS two FROM wire WHERE {rows})"


def _windowed(rule: str, severity: str, position: int, rows: str, *of_window) -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, {position} AS position, source, destination, destination_port, confidence, first_seen_ns, last_seen_ns, related, split_part(evidence, ';', 1) AS fact FROM (WITH {rows}, {window_sql('f', *of_window)})"


def _grouped(rule: str, severity: str, position: int, rows: str, key: str, columns: str, having: str = "true") -> str:
    return f"""SELECT '{rule}', '{severity}', {position}, {columns.replace('@times', "min(first_seen_ns), max(last_seen_ns), string_agg(CAST(flow_id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 50)")}
 FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY first_seen_ns, flow_id) AS r, CASE WHEN lag(first_seen_ns) OVER w IS NOT NULL THEN greatest(first_seen_ns / 1e9 - lag(first_seen_ns / 1e9) OVER w, 0) END AS gap FROM hosts WHERE {rows} WINDOW w AS (PARTITION BY {key} ORDER BY first_seen_ns, flow_id)) GROUP BY {key} HAVING {having}"""


_FLOW = ("first_seen_ns", "flow_id", "last_seen_ns", True)
_PACKET = ("ts_ns", "packet_index", "ts_ns", False)
_COMMON = "20, 21, 22, 23, 25, 53, 67, 68, 80, 110, 123, 143, 161, 389, 443, 445, 465, 587, 636, 993, 995, 3389, 5353, 8080"
_PORTED = "(SELECT count(*) FROM hosts WHERE ported)"
_TUNNEL = ORACLE_SQL["r10_dns_tunnel"].removeprefix(f"WITH {QUESTIONS}, ")

ALERTS = f"""{WALK}, {ENDS},
 fl AS MATERIALIZED (SELECT row_number() OVER (ORDER BY e.first_packet) AS flow_id, e.first_packet, e.protocol, o.initiator_ip, o.responder_ip, o.initiator_port, o.responder_port, o.basis, e.tcp_state, e.end_reason, e.begin_ns, e.end_ns FROM endings e JOIN opened o ON o.opener = e.first_packet),
 sides AS (SELECT first_packet, CAST(sum(payload_length) AS BIGINT) AS payload, count(*) FILTER (NOT forward) AS back_packets, CAST(coalesce(sum(wire_length) FILTER (forward), 0) AS BIGINT) AS bytes_out, CAST(coalesce(sum(wire_length) FILTER (NOT forward), 0) AS BIGINT) AS bytes_back FROM flowed GROUP BY first_packet),
 h0 AS (SELECT flow_id, initiator_ip AS src, responder_ip AS dst, protocol, initiator_port, CAST(responder_port AS INTEGER) AS responder_port, basis, tcp_state AS state, payload, back_packets, bytes_out, bytes_back, begin_ns AS first_seen_ns, end_ns AS last_seen_ns,
  coalesce(protocol = 6 AND basis = 'tcp_syn' AND (tcp_state = 'syn_sent' OR (tcp_state = 'reset' AND payload = 0)), false) AS failed, responder_port <> 0 AS ported FROM fl JOIN sides USING (first_packet)),
 hosts AS MATERIALIZED (SELECT *, back_packets > 0 AND NOT failed AS answered FROM h0),
 {QUESTIONS.removeprefix(WIRE + ', ')},
 base AS ({_windowed('scan_syn', 'medium', 0, 'f AS (SELECT * FROM hosts WHERE failed)', 'src, dst', 'count(DISTINCT b.responder_port)', WIDTH, 1, f'src AS source, dst AS destination, {NO_PORT}', *_FLOW, 'distinct_ports_unanswered_or_refused')}
 UNION ALL {_windowed('scan_ports', 'medium', 1, 'f AS (SELECT * FROM hosts WHERE ported)', 'src, dst', 'count(DISTINCT (b.protocol, b.responder_port))', WIDTH, 2, f'src AS source, dst AS destination, {NO_PORT}', *_FLOW, 'distinct_destination_ports')}
 UNION ALL {_windowed('scan_hosts', 'medium', 2, 'f AS (SELECT * FROM hosts WHERE ported AND NOT answered)', 'src, protocol, responder_port', 'count(DISTINCT b.dst)', WIDTH, 2, 'src AS source, CAST(NULL AS VARCHAR) AS destination, responder_port AS destination_port', *_FLOW, 'distinct_hosts_unanswered_or_refused')}
 UNION ALL {_windowed('tcp_fail', 'low', 3, 'f AS (SELECT * FROM hosts WHERE failed)', 'src', 'count(*)', WIDTH, 2, f'src AS source, {NO_END}', *_FLOW, 'failed_connection_attempts')}
 UNION ALL {_grouped('beacon', 'medium', 4, 'ported', 'src, dst, protocol, responder_port', "src, dst, responder_port, CASE WHEN count(*) >= 6 AND stddev_pop(gap) / avg(gap) <= 0.4 THEN 'high' ELSE 'medium' END, @times, 'connections=' || count(*)", 'count(*) >= 3 AND avg(gap) >= 10 AND stddev_pop(gap) / avg(gap) <= 0.8')}
 UNION ALL {_grouped('rare_port', 'low', 5, 'ported', 'protocol, responder_port', "arg_min(src, r), arg_min(dst, r), responder_port, 'low', @times, 'flows_to_port=' || count(*)", f"count(*) <= 20 AND responder_port NOT IN ({_COMMON}) AND responder_port < 49152 AND bool_and(CASE WHEN protocol = 17 THEN initiator_port >= 1024 AND initiator_port NOT IN ({_COMMON}) ELSE basis <> 'first_packet' END) AND bool_or(answered) AND {_PORTED} >= 50")}
 UNION ALL {_grouped('outbound_ratio', 'medium', 6, "src LIKE '10.%' AND dst NOT LIKE '10.%' AND bytes_out >= 300 AND (bytes_back = 0 OR CAST(bytes_out AS DOUBLE) / bytes_back >= 1.5)", 'src, dst', "src, dst, NULL, CASE WHEN sum(bytes_out) >= 3000 THEN 'high' ELSE 'medium' END, @times, 'bytes_sent=' || CAST(sum(bytes_out) AS BIGINT)")}
 UNION ALL {_grouped('cleartext', 'low', 7, 'protocol = 6 AND answered AND responder_port = 80', 'src, dst, responder_port', "src, dst, responder_port, 'medium', @times, 'destination_port=' || responder_port")}
 UNION ALL {_windowed('dns_volume', 'low', 8, _clocked('dns_query IS NOT NULL AND NOT dns_response', PACKET_WIDTH), 'src_ip', 'count(*)', PACKET_WIDTH, 3, f'src_ip AS source, {NO_END}', *_PACKET, 'queries_in_window')}
 UNION ALL SELECT 'dns_tunnel', 'high', 9, source, destination, destination_port, confidence, first_seen_ns, last_seen_ns, related, split_part(evidence, ';', 1) FROM (WITH {_TUNNEL})
 UNION ALL {_windowed('arp_conflict', 'high', 10, _clocked("sender_ip <> '0.0.0.0'", PACKET_WIDTH), 'sender_ip', 'count(DISTINCT b.sender_mac)', PACKET_WIDTH, 2, f'sender_ip AS source, {NO_END}', *_PACKET, 'mac_addresses_in_window')}
 UNION ALL {_windowed('arp_gratuitous', 'low', 11, _clocked("gratuitous AND sender_ip <> '0.0.0.0'", PACKET_WIDTH), 'sender_mac', 'count(*)', PACKET_WIDTH, 2, f'sender_mac AS source, {NO_END}', *_PACKET, 'gratuitous_arp_in_window')}),
 capped AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY first_seen_ns, source, destination, destination_port) AS r FROM base), alerts AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY position, r) AS alert_id FROM capped WHERE r <= 1000),
 each_cite AS (SELECT alert_id, severity, position >= 8 AS of_packets, CAST(unnest(string_split(related, ',')) AS BIGINT) AS id, generate_subscripts(string_split(related, ','), 1) AS spot FROM alerts),
 flow_cites AS (SELECT alert_id, any_value(severity) AS severity, coalesce(fl.flow_id, CASE WHEN NOT of_packets THEN id END) AS flow_id, min(spot) AS spot FROM each_cite LEFT JOIN packed ON of_packets AND packed.packet_index = id LEFT JOIN fl ON fl.first_packet = packed.first_packet GROUP BY alert_id, coalesce(fl.flow_id, CASE WHEN NOT of_packets THEN id END) HAVING coalesce(fl.flow_id, CASE WHEN NOT of_packets THEN id END) IS NOT NULL),
 flow_lists AS (SELECT alert_id, string_agg(CAST(flow_id AS VARCHAR), ',' ORDER BY spot) AS related_flows FROM flow_cites GROUP BY alert_id)"""


@query(f"""WITH RECURSIVE {ALERTS} SELECT CAST(a.alert_id AS INTEGER) AS alert_id, rule, severity, confidence, source, destination, destination_port, first_seen_ns, last_seen_ns, fact, CASE WHEN position >= 8 THEN related ELSE '' END AS related_packets, coalesce(related_flows, '') AS related_flows FROM alerts a LEFT JOIN flow_lists l ON a.alert_id = l.alert_id""")
def r1_r12_capture_alerts(spark, d):
    """All twelve rules on the flows and packets of one capture, with both lists of citations."""
    alerts = analysis.analyse(views.wire(spark, d), SETTINGS).alerts
    first = F.element_at("evidence", 1)
    lists = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("related_packets", "related_flows")]
    return alerts.select("alert_id", "rule", "severity", "confidence", "source", "destination", "destination_port", "first_seen_ns", "last_seen_ns", F.concat(first["name"], F.lit("="), first["value"]).alias("fact"), *lists)


@query(f"""WITH RECURSIVE {ALERTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY alert_id) AS r FROM flow_cites),
 links AS (SELECT flow_id, string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY alert_id) FILTER (r <= 16) AS alert_ids, least(count(*), 16) AS alert_count, arg_max(severity, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS max_severity FROM ranked GROUP BY flow_id)
 SELECT f.flow_id, first_packet, initiator_ip, responder_ip, tcp_state, end_reason, coalesce(alert_ids, '') AS alert_ids, CAST(coalesce(alert_count, 0) AS INTEGER) AS alert_count, max_severity FROM fl f LEFT JOIN links l ON f.flow_id = l.flow_id""")
def u9_u11_capture_flows(spark, d):
    """Every flow of a capture with its end and the alerts that cite it or one of its packets."""
    linked = analysis.analyse(views.wire(spark, d), SETTINGS).flows_with_alerts()
    return linked.select("flow_id", "first_packet", "initiator_ip", "responder_ip", "tcp_state", "end_reason", F.coalesce(F.array_join(F.transform("alert_ids", lambda x: x.cast("string")), ","), F.lit("")).alias("alert_ids"), "alert_count", "max_severity")


@query(f"""WITH RECURSIVE {ALERTS} SELECT (SELECT count(*) FROM wire) AS packets, CAST(0 AS BIGINT) AS packets_without_time, CAST(0 AS BIGINT) AS timestamp_outliers, CAST(0 AS BIGINT) AS clock_jumps, (SELECT count(*) FROM fl) AS flows_evaluated, CAST(0 AS BIGINT) AS flows_without_time,
 (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM (SELECT rule FROM alerts GROUP BY rule HAVING count(*) >= 1000)) AS rules_at_limit, (SELECT count(*) FILTER (NOT let_in) FROM ({' UNION ALL '.join(_evaluated(r, PACKET_WIDTH) for r in ("dns_query IS NOT NULL AND NOT dns_response", "sender_ip <> '0.0.0.0'", "gratuitous AND sender_ip <> '0.0.0.0'"))})) AS events_not_evaluated""")
def u12_capture_summary(spark, d):
    return analysis.analyse(views.wire(spark, d), SETTINGS).summary(SETTINGS)


# --- a clock that is wrong at times: lone times far off, times that are missing, and stretches that lie ten weeks back ----------------------------

TOLERANCE = 10 * DAY
DISTURBED = f"""{WIRE.replace('wire AS (SELECT packet_index, ts_ns,', 'wire0 AS (SELECT packet_index, ts_ns,')},
 wire AS (SELECT * REPLACE (CASE WHEN packet_index % 89 = 7 THEN NULL WHEN packet_index % 97 = 13 THEN ts_ns + {400 * DAY} WHEN packet_index // 400 % 2 = 1 THEN ts_ns - {70 * DAY} ELSE ts_ns END AS ts_ns) FROM wire0)"""
STEPS = f"""{DISTURBED}, timed AS (SELECT packet_index, ts_ns, row_number() OVER (ORDER BY packet_index) AS n FROM wire WHERE ts_ns IS NOT NULL),
 walked AS (SELECT n, packet_index, ts_ns AS clock, CAST(NULL AS BIGINT) AS held_ns, CAST(0 AS BIGINT) AS epoch, 0 AS step FROM timed WHERE n = 1
  UNION ALL SELECT t.n, t.packet_index, CASE WHEN near THEN greatest(w.clock, t.ts_ns) WHEN agrees THEN greatest(w.held_ns, t.ts_ns) ELSE w.clock END, CASE WHEN near OR agrees THEN NULL ELSE t.ts_ns END,
   w.epoch + CASE WHEN NOT near AND agrees AND greatest(w.held_ns, t.ts_ns) < w.clock THEN 1 ELSE 0 END, CASE WHEN near THEN 0 WHEN agrees THEN CASE WHEN greatest(w.held_ns, t.ts_ns) < w.clock THEN 3 ELSE 2 END ELSE 1 END
  FROM walked w JOIN timed t ON t.n = w.n + 1, LATERAL (SELECT abs(t.ts_ns - w.clock) <= {TOLERANCE} AS near, coalesce(abs(t.ts_ns - w.held_ns) <= {TOLERANCE}, false) AS agrees)),
 after AS (SELECT *, lead(step) OVER (ORDER BY n) AS next_step FROM walked),
 clocks AS (SELECT w.packet_index, w.ts_ns, last_value(a.clock IGNORE NULLS) OVER o AS clock, coalesce(last_value(a.epoch IGNORE NULLS) OVER o, 0) AS epoch, coalesce(a.step = 1, false) AS held, CASE WHEN a.step = 1 AND a.next_step >= 2 THEN a.next_step ELSE 0 END AS confirmed
  FROM wire w LEFT JOIN after a USING (packet_index) WINDOW o AS (ORDER BY w.packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def disturbed(spark, d):
    i = F.col("packet_index")
    ts = F.when(i % 89 == 7, None).when(i % 97 == 13, F.col("ts_ns") + 400 * DAY).when(F.floor(i / 400) % 2 == 1, F.col("ts_ns") - 70 * DAY).otherwise(F.col("ts_ns"))
    return views.wire(spark, d).withColumn("ts_ns", ts)


@query(f"WITH RECURSIVE {STEPS} SELECT packet_index, coalesce(clock, (SELECT min(ts_ns) FROM timed WHERE n = 1)) AS clock, epoch, held, CAST(confirmed AS INTEGER) AS confirmed FROM clocks")
def w3_w26_doubted_clock(spark, d):
    """The clock of every packet, its epoch, and whether its time was held and then confirmed."""
    out = clock.clocked(disturbed(spark, d), TOLERANCE, span=500)
    return out.select("packet_index", "clock", "epoch", "held", F.col("confirmed").cast("int").alias("confirmed"))


#: Flows of UDP and of TCP without its states: an idle gap of the flow's time, or a new epoch.
RESET_FLOWS = f"""{STEPS}, timeline AS (SELECT packet_index, coalesce(c.clock, (SELECT min(ts_ns) FROM timed WHERE n = 1)) AS clock, c.epoch, c.held, c.confirmed, c.ts_ns, w.protocol, w.src_key || printf('%05d', coalesce(w.src_port, 0)) AS s, w.dst_key || printf('%05d', coalesce(w.dst_port, 0)) AS t, w.src_ip FROM clocks c JOIN wire w USING (packet_index)),
 keyed AS (SELECT *, epoch || '|' || least(s, t) || '|' || greatest(s, t) AS key, greatest(clock, CASE WHEN confirmed = 2 THEN ts_ns END) AS reached, CASE WHEN NOT held OR confirmed > 0 THEN ts_ns END AS counts FROM timeline WHERE src_ip IS NOT NULL AND protocol = 17),
 gaps AS (SELECT *, coalesce(clock - max(reached) OVER (PARTITION BY key ORDER BY packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {OTHER_IDLE}, true) AS fresh FROM keyed),
 named AS (SELECT *, max(CASE WHEN fresh THEN packet_index END) OVER (PARTITION BY key ORDER BY packet_index) AS first_packet FROM gaps),
 told AS (SELECT *, max(counts) OVER (PARTITION BY first_packet ORDER BY packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM named),
 recs AS (SELECT first_packet, any_value(key) AS key, any_value(epoch) AS epoch, max(reached) AS last_clock, count(*) AS packets, min(counts) AS first_seen_ns, max(counts) AS last_seen_ns, count(*) FILTER (ts_ns IS NULL) AS missing_timestamp, count(*) FILTER (held AND confirmed = 0) AS timestamp_outliers, count(*) FILTER (NOT held AND ts_ns < earlier) AS out_of_order FROM told GROUP BY first_packet),
 finals AS (SELECT epoch, max(clock) AS final FROM timeline GROUP BY epoch)"""


@query(f"""WITH RECURSIVE {RESET_FLOWS} SELECT r.first_packet, r.packets, r.first_seen_ns, r.last_seen_ns, r.missing_timestamp, r.timestamp_outliers, r.out_of_order,
 CASE WHEN r.first_packet < max(r.first_packet) OVER (PARTITION BY r.key) OR f.final > r.last_clock + {OTHER_IDLE} THEN 'idle_timeout' WHEN r.epoch < (SELECT max(epoch) FROM finals) THEN 'clock_reset' ELSE 'capture_end' END AS end_reason FROM recs r JOIN finals f ON f.epoch = r.epoch""")
def w14_w25_flows_of_a_doubted_clock(spark, d):
    """UDP flows where the clock jumps: held times that count only when confirmed, and flows that a jump back ends."""
    table = clock.clocked(disturbed(spark, d), TOLERANCE)
    packets = alert_queries.materialize(flows.flows_of(table.filter("protocol = 17"), TCP_IDLE, OTHER_IDLE, LINGER), "flowed")
    done = flows.end_reasons(flows.flow_records(packets), flows.tcp_summary(packets).select("first_packet", "tcp_state"), flows.epoch_ends(table), TCP_IDLE, OTHER_IDLE, LINGER)
    late = flows.arrival_gaps(packets).groupBy("first_packet").agg(F.count_if("out_of_order").alias("out_of_order"))
    return done.join(late, "first_packet").select("first_packet", F.col("packets_total").alias("packets"), "first_seen_ns", "last_seen_ns", "missing_timestamp", "timestamp_outliers", "out_of_order", "end_reason")


@query(f"WITH RECURSIVE {STEPS} SELECT count(*) FILTER (held AND confirmed = 0) AS timestamp_outliers, count(*) FILTER (confirmed > 0) AS clock_jumps FROM clocks")
def w27_clock_summary(spark, d):
    return clock.clock_summary(clock.clocked(disturbed(spark, d), TOLERANCE))
