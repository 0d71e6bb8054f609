"""Queries of lists, look-ups, filters, accounts and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import lookups, text
from netloom.functions import predicates as p
from netloom.operators import detect, lists, rules
from netloom.plans.catalog import FLOWS, PACKETS, query
from netloom.plans.flow_queries import WIRE
from netloom.sources import views

PROTOCOLS = "CASE WHEN arp THEN ['ethernet', 'arp'] WHEN fragment THEN ['ethernet', CASE WHEN src_key LIKE '6%' THEN 'ipv6' ELSE 'ipv4' END] ELSE list_concat(['ethernet', CASE WHEN src_key LIKE '6%' THEN 'ipv6' ELSE 'ipv4' END, CASE protocol WHEN 6 THEN 'tcp' ELSE 'udp' END], CASE WHEN dns_query IS NOT NULL THEN ['dns'] WHEN http_host IS NOT NULL THEN ['http'] WHEN tls_sni IS NOT NULL THEN ['tls'] ELSE [] END) END AS protocols"


def packets(spark, d):
    """The wire's packets with their protocols, as stored."""
    family = F.when(F.octet_length("src_bin") == 16, "ipv6").otherwise("ipv4")
    app = F.when(F.col("dns_query").isNotNull(), "dns").when(F.col("http_host").isNotNull(), "http").when(F.col("tls_sni").isNotNull(), "tls")
    names = F.array(F.lit("ethernet"), F.when(F.col("src_bin").isNull(), "arp").otherwise(family), F.when(~F.col("fragment") & F.col("src_bin").isNotNull(), F.when(F.col("protocol") == 6, "tcp").otherwise("udp")), app)
    return views.wire(spark, d).withColumn("protocols", F.array_compact(names))


def picked(spark, d, condition):
    return packets(spark, d).filter(condition).select("packet_index")


PACKED = f"{WIRE}, packed AS (SELECT *, least(wire_length, 512) AS captured_length, {PROTOCOLS} FROM wire)"


@query(f"WITH {PACKED} SELECT packet_index FROM packed WHERE src_ip LIKE '10.0.0.%' AND protocol = 6")
def f9_network_filter(spark, d):
    return picked(spark, d, p.compare(p.PACKET_FIELDS, "ip.src", "==", "10.0.0.77/24") & p.compare(p.PACKET_FIELDS, "ip.proto", "==", 6))


@query(f"WITH {PACKED} SELECT packet_index FROM packed WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL AND NOT (src_ip LIKE '2001:db8:%' OR dst_ip LIKE '2001:db8:%') AND wire_length >= 100 AND captured_length < 400 AND wire_length <= 900 AND packet_index > 10")
def f9_f13_outside_a_network(spark, d):
    f = p.PACKET_FIELDS
    bounds = p.compare(f, "frame.len", ">=", 100) & p.compare(f, "frame.len", "<=", 900) & p.compare(f, "frame.cap_len", "<", 400) & p.compare(f, "frame.number", ">", 10)
    return picked(spark, d, p.compare(f, "ip.addr", "!=", "2001:db8::/32") & bounds)


@query(f"WITH {PACKED} SELECT packet_index FROM packed WHERE lower(http_host) = 'www3.example.org' OR (tls_sni LIKE '%cdn2%' AND (src_port = 443 OR dst_port = 443)) OR (lower(dns_query) LIKE '%host13%' AND NOT coalesce(dst_port = 53, false))")
def f11_names(spark, d):
    f = p.PACKET_FIELDS
    tls = p.compare(f, "tls.sni", "contains", "CDN2") & p.compare(f, "tcp.port", "==", 443)
    dns = p.compare(f, "dns.qry.name", "contains", "host13") & p.negate(p.compare(f, "udp.dstport", "==", 53))
    return picked(spark, d, p.compare(f, "http.host", "==", "WWW3.Example.org") | tls | dns)


@query(f"WITH {PACKED} SELECT packet_index FROM packed WHERE (list_contains(protocols, 'arp') OR list_contains(protocols, 'ipv6')) AND NOT coalesce(tcp_flags & 4 <> 0, false)")
def f7_presence(spark, d):
    f = p.PACKET_FIELDS
    return picked(spark, d, (p.present(f, "arp") | p.present(f, "ipv6")) & p.negate(p.present(f, "tcp.flags.rst")))


@query(f"WITH {PACKED} SELECT name, count(*) AS packets, min(packet_index) AS first_index FROM (SELECT packet_index, unnest(list_distinct(protocols)) AS name FROM packed) GROUP BY name")
def d25_protocol_counts(spark, d):
    each = packets(spark, d).select("packet_index", F.explode(F.array_distinct("protocols")).alias("name"))
    return each.groupBy("name").agg(F.count(F.lit(1)).alias("packets"), F.min("packet_index").alias("first_index"))


@query(f"WITH {PACKED} SELECT packet_index, protocols[-1] AS top_protocol, coalesce(src_ip, sender_mac) AS source, list_contains(protocols, 'dns') AS has_dns FROM packed")
def d23_endpoints(spark, d):
    return packets(spark, d).select("packet_index", F.element_at("protocols", -1).alias("top_protocol"), F.coalesce("src_ip", "sender_mac").alias("source"), F.array_contains("protocols", "dns").alias("has_dns"))


@query(f"WITH {PACKED} SELECT packet_index, lower(dns_query) AS query_name, dns_response AS is_response, CASE record_type WHEN 1 THEN 'A' WHEN 16 THEN 'TXT' END AS query_type FROM packed WHERE dns_query IS NOT NULL ORDER BY packet_index LIMIT 50")
def q9_dns_events(spark, d):
    events = packets(spark, d).filter("dns_query IS NOT NULL").select("packet_index", F.lower("dns_query").alias("query_name"), F.col("dns_response").alias("is_response"), lookups.dns_type_name(F.col("record_type")).alias("query_type"))
    return lists.page(events.orderBy("packet_index"), 1, 50)


@query(f"WITH {PACKED} SELECT packet_index, 'http' AS kind, http_host AS name FROM packed WHERE http_host IS NOT NULL UNION ALL SELECT packet_index, 'tls', tls_sni FROM packed WHERE tls_sni IS NOT NULL")
def d26_http_and_tls_events(spark, d):
    stored = packets(spark, d)
    return stored.filter("http_host IS NOT NULL").select("packet_index", F.lit("http").alias("kind"), F.col("http_host").alias("name")).union(stored.filter("tls_sni IS NOT NULL").select("packet_index", F.lit("tls"), "tls_sni"))


@query(f"""WITH {PACKED} SELECT sort, place, packet_index FROM (SELECT 'number' AS sort, row_number() OVER (ORDER BY packet_index) AS place, packet_index FROM packed UNION ALL SELECT 'newest', row_number() OVER (ORDER BY packet_index DESC), packet_index FROM packed
 UNION ALL SELECT 'time', row_number() OVER (ORDER BY ts_ns, packet_index), packet_index FROM packed UNION ALL SELECT 'length', row_number() OVER (ORDER BY wire_length DESC, packet_index), packet_index FROM packed) WHERE place <= 25""")
def q3_packet_sorts(spark, d):
    wire = views.wire(spark, d).select("packet_index", "ts_ns", "original_length")
    return lists.labelled_pages({by: lists.page(lists.sorted_by(wire, lists.PACKET_SORTS, by), 1, 25).select("packet_index") for by in lists.PACKET_SORTS})


SESSIONS_SQL = "sessions AS (SELECT o_custkey AS user_id, o_orderkey AS session_id, epoch_us(o_orderdate) AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderkey % 97 AS packets, o_orderstatus AS state, o_orderpriority AS priority FROM orders)"


def sessions(spark, d):
    """Orders as capture sessions: one a user, with times, sizes and a state."""
    return views.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("session_id"), views.micros("o_orderdate").alias("created_at"), F.floor("o_totalprice").cast("bigint").alias("bytes"), (F.col("o_orderkey") % 97).alias("packets"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"))


@query(f"""WITH {SESSIONS_SQL} SELECT sort, place, session_id FROM (SELECT 'newest' AS sort, row_number() OVER (ORDER BY created_at DESC, session_id DESC) AS place, session_id FROM sessions UNION ALL SELECT 'oldest', row_number() OVER (ORDER BY created_at, session_id), session_id FROM sessions
 UNION ALL SELECT 'packets', row_number() OVER (ORDER BY packets DESC, session_id DESC), session_id FROM sessions UNION ALL SELECT 'size', row_number() OVER (ORDER BY bytes DESC, session_id DESC), session_id FROM sessions) WHERE place <= 25""")
def q2_session_sorts(spark, d):
    stored = sessions(spark, d)
    return lists.labelled_pages({by: lists.page(lists.sorted_by(stored, lists.SESSION_SORTS, by), 1, 25).select("session_id") for by in lists.SESSION_SORTS})


@query(f"WITH {SESSIONS_SQL} SELECT count(*) AS n FROM sessions WHERE state = 'F' AND packets > 50")
def q6_filtered_count(spark, d):
    return sessions(spark, d).filter("state = 'F' AND packets > 50").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SESSIONS_SQL} SELECT *, session_id IN (SELECT l_orderkey FROM lineitem) AS has_flows FROM sessions WHERE session_id = 77")
def q11_point_look_up(spark, d):
    one = lists.equal_to(sessions(spark, d), session_id=77).limit(1)
    held = views.flow_lines(spark, d).filter("l_orderkey = 77").limit(1).agg((F.count(F.lit(1)) > 0).alias("x")).scalar()
    return one.withColumn("has_flows", held)


@query(f"""WITH {SESSIONS_SQL}, alerts AS (SELECT CASE priority[1] WHEN '1' THEN 'high' WHEN '2' THEN 'medium' ELSE 'low' END AS severity, CASE state WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'acknowledged' END AS status FROM sessions), g AS (SELECT severity, status, count(*) AS n FROM alerts GROUP BY ALL)
 SELECT 'captures' AS part, '' AS name, (SELECT count(*) FROM sessions) AS n UNION ALL SELECT 'packets', '', CAST((SELECT sum(packets) FROM sessions) AS BIGINT) UNION ALL SELECT 'by_severity', severity, CAST(sum(n) AS BIGINT) FROM g GROUP BY severity UNION ALL SELECT 'by_status', status, CAST(sum(n) AS BIGINT) FROM g GROUP BY status
 UNION ALL SELECT 'open_by_severity', severity, n FROM g WHERE status = 'open' UNION ALL SELECT 'newest', CAST(row_number() OVER (ORDER BY created_at DESC, session_id DESC) AS VARCHAR), session_id FROM sessions QUALIFY row_number() OVER (ORDER BY created_at DESC, session_id DESC) <= 5""")
def q12_overview(spark, d):
    stored = sessions(spark, d)
    severity = F.when(F.col("priority").startswith("1"), "high").when(F.col("priority").startswith("2"), "medium").otherwise("low")
    status = F.when(F.col("state") == "O", "open").when(F.col("state") == "F", "closed").otherwise("acknowledged")
    return lists.overview(stored, stored.select(severity.alias("severity"), status.alias("status")), "session_id", lists.SESSION_SORTS["newest"])


@query(f"WITH {SESSIONS_SQL} SELECT session_id FROM sessions WHERE created_at >= (SELECT max(created_at) FROM sessions) - 365 * 86400000000 AND session_id <> 5")
def q14_purged_sessions(spark, d):
    stored = sessions(spark, d)
    now = F.timestamp_micros(stored.agg(F.max("created_at")).scalar())
    kept = lists.kept_after(stored.withColumn("at", F.timestamp_micros("created_at")), "at", now, 365)
    return lists.without_session({"sessions": kept}, 5)["sessions"].select("session_id")


@query(f"WITH {PACKETS} SELECT packet_index, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.') || printf('%09d', ts_ns % 1000000000) || 'Z' AS utc FROM packets")
def q15_utc_text(spark, d):
    return views.packets(spark, d).select("packet_index", lists.utc_text(F.col("ts_ns")).alias("utc"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 3 ORDER BY event_id DESC LIMIT 20")
def a1_audit_list(spark, d):
    found = lists.equal_to(views.table(spark, d, "events"), event_type="click", user_id=3, value=None)
    return lists.page(found.orderBy(F.desc("event_id")), 1, 20).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def a2_audit_retention(spark, d):
    events = views.table(spark, d, "events")
    return lists.kept_after(events, "ts", events.agg(F.max("ts")).scalar(), 7).select("event_id")


@query(f"WITH {SESSIONS_SQL}, now AS (SELECT max(created_at) AS t FROM sessions) SELECT s.session_id, c.c_custkey AS user_id, c.c_name AS name FROM sessions s JOIN customer c ON s.user_id = c.c_custkey, now WHERE s.created_at > t - 90 * 86400000000 AND c.c_mktsegment <> 'BUILDING'")
def a3_sessions_of_users(spark, d):
    stored = sessions(spark, d)
    live = stored.filter(F.col("created_at") > stored.agg(F.max("created_at")).scalar() - 90 * 86_400_000_000)
    users = views.table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'")
    return live.join(users, F.col("user_id") == F.col("c_custkey")).select("session_id", "user_id", F.col("c_name").alias("name"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 10 OFFSET 10")
def a5_user_list(spark, d):
    return lists.page(views.table(spark, d, "customer").orderBy("c_name"), 2, 10).select("c_custkey", "c_name")


@query(f"WITH {SESSIONS_SQL}, now AS (SELECT max(created_at) AS t FROM sessions) SELECT session_id FROM sessions, now WHERE state <> 'P' AND created_at > t - 200 * 86400000000")
def a6_live_sessions(spark, d):
    stored = sessions(spark, d)
    return stored.filter((F.col("state") != "P") & (F.col("created_at") > stored.agg(F.max("created_at")).scalar() - 200 * 86_400_000_000)).select("session_id")


# targets made of urls: user info, a second @, parameters, tokens, embedded urls, marks in the authority, and other schemes
_PATHS = {0: "url", 1: "'http://user:p@ss@' || regexp_replace(url, '^[a-z]+://', '')", 2: "regexp_replace(url, '[?#].*$', '') || ';jsessionid=SECRET/x'", 3: "'https://h.example.org?x/' || page_id", 4: "'/fetch/https://u:pw@' || page_id || '.example/x'", 5: "'/reset/abcdef1234567890' || page_id || '/ok'", 6: "'ftp://h.example/' || page_id", 7: "'//h.example/' || page_id", 8: "'/mail/me%40example/' || page_id", 9: "'HTTP://H.Example:8080'"}
_CASES = "CASE " + " ".join(f"WHEN page_id % 10 = {k} THEN {v}" for k, v in _PATHS.items()) + " END AS target"
TARGETS = f"""t AS (SELECT page_id, {_CASES} FROM pages), a AS (SELECT *, regexp_matches(target, '^https?://', 'i') AS absolute, regexp_replace(target, '^https?://', '', 'i') AS rest FROM t),
 b AS (SELECT *, split_part(rest, '/', 1) AS authority FROM a), c AS (SELECT *, string_split(authority, '@')[-1] AS named FROM b),
 h AS (SELECT *, CASE WHEN absolute AND strpos(authority, '?') = 0 AND strpos(authority, '#') = 0 AND regexp_full_match(named, '[A-Za-z0-9_-][A-Za-z0-9._-]*(:[0-9]{{1,5}})?') THEN lower(named) END AS host FROM c),
 p AS (SELECT *, CASE WHEN target LIKE '/%' AND target NOT LIKE '//%' THEN target WHEN host IS NOT NULL THEN CASE WHEN length(rest) = length(authority) THEN '/' ELSE substr(rest, length(authority) + 1) END END AS path FROM h),
 s AS (SELECT page_id, host, string_split(regexp_replace(path, '[?#;].*$', ''), '/') AS parts FROM p),
 m AS (SELECT *, list_filter(range(1, len(parts) - 1), lambda i: regexp_full_match(parts[i], '[A-Za-z][A-Za-z0-9+.-]*:') AND parts[i + 1] = '')[1] AS cut FROM s),
 masked AS (SELECT page_id, host, CASE WHEN parts IS NOT NULL THEN array_to_string(list_concat(list_transform(CASE WHEN cut IS NULL THEN parts ELSE parts[: cut - 1] END, lambda x: CASE WHEN length(x) >= 32 OR (length(x) >= 16 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')) OR strpos(x, '@') > 0 OR strpos(x, '%40') > 0 THEN '{{redacted}}' ELSE x END), CASE WHEN cut IS NULL THEN [] ELSE ['{{redacted}}'] END), '/') END AS path FROM m)"""


@query(f"WITH {TARGETS} SELECT page_id, host, path FROM masked")
def d14_d15_redacted_targets(spark, d):
    shown = views.table(spark, d, "pages").select("page_id", F.expr(_CASES.removesuffix(" AS target")).alias("target"))
    host, path = text.redact_target(F.col("target"))
    return shown.select("page_id", host.alias("host"), path.alias("path"))


@query("SELECT page_id, CASE WHEN regexp_full_match(h, '[A-Za-z0-9_-][A-Za-z0-9._-]*(:[0-9]{1,5})?') AND length(split_part(h, ':', 1)) <= 253 THEN lower(h) END AS host FROM (SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN ':443' WHEN 2 THEN ':1234567' ELSE ' x' END AS h FROM pages)")
def d16_host_values(spark, d):
    tail = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, ":443").when(F.col("page_id") % 4 == 2, ":1234567").otherwise(" x")
    host = F.concat(F.substring_index(F.regexp_replace("url", "^[a-z]+://", ""), "/", 1), tail)
    return views.table(spark, d, "pages").select("page_id", text.host_value(host).alias("host"))


@query("SELECT doc_id, regexp_replace(text[1:80], '[^\\x20-\\x7e]', '?', 'g') AS shown FROM documents WHERE text IS NOT NULL")
def d20_printable(spark, d):
    docs = views.table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", text.printable(F.col("text"), 80).alias("shown"))


@query("SELECT event_id, (event_id % 65536) // 256 = event_id % 256 AND event_id % 16 = 10 AS grease FROM events")
def d19_grease(spark, d):
    return views.table(spark, d, "events").select("event_id", text.is_grease((F.col("event_id") % 65536).cast("int")).alias("grease"))


@query("SELECT event_id, CASE event_id % 140 WHEN 0 THEN 'IPv6 Hop-by-Hop' WHEN 1 THEN 'ICMP' WHEN 2 THEN 'IGMP' WHEN 4 THEN 'IPv4-in-IP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 41 THEN 'IPv6-in-IP' WHEN 43 THEN 'IPv6 Routing' WHEN 44 THEN 'IPv6 Fragment' WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP' WHEN 51 THEN 'AH' WHEN 58 THEN 'ICMPv6' WHEN 59 THEN 'IPv6 No Next Header' WHEN 60 THEN 'IPv6 Destination Options' WHEN 89 THEN 'OSPF' WHEN 103 THEN 'PIM' WHEN 112 THEN 'VRRP' WHEN 132 THEN 'SCTP' WHEN 135 THEN 'Mobility' END AS name FROM events")
def d21_protocol_names(spark, d):
    return views.table(spark, d, "events").select("event_id", lookups.ip_protocol_name((F.col("event_id") % 140).cast("int")).alias("name"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), l AS (SELECT page_id, host, unnest(string_split(host, '')) AS c FROM h), n AS (SELECT page_id, c, count(*) AS n, any_value(length(host)) AS total FROM l WHERE c <> '' GROUP BY page_id, c)
 SELECT page_id, round(-sum(n / CAST(total AS DOUBLE) * log2(n / CAST(total AS DOUBLE))), 6) AS bits FROM n GROUP BY page_id""")
def u1_entropy(spark, d):
    return views.table(spark, d, "pages").select("page_id", F.round(text.entropy(F.regexp_extract("url", "://([^/?#]*)", 1)), 6).alias("bits"))


@query(f"WITH {WIRE} SELECT src_ip, count(DISTINCT lower(dns_query)) AS subdomains FROM wire WHERE dns_query IS NOT NULL AND NOT dns_response GROUP BY src_ip")
def u4_distinct_subdomains(spark, d):
    asked = views.wire(spark, d).filter("dns_query IS NOT NULL AND NOT dns_response")
    return asked.groupBy("src_ip").agg(F.countDistinct(F.lower("dns_query")).alias("subdomains"))


@query(f"WITH {WIRE} SELECT packet_index, src_ip LIKE '10.%' AS inside, dst_ip LIKE '192.0.2.%' AS test_net FROM wire WHERE src_ip IS NOT NULL")
def u6_networks(spark, d):
    seen = views.wire(spark, d).filter("src_bin IS NOT NULL")
    return seen.select("packet_index", p.in_network(F.col("src_bin"), "10.0.0.0/8").alias("inside"), p.in_network(F.col("dst_bin"), "192.0.2.0/24").alias("test_net"))


@query(f"WITH {FLOWS}, g AS (SELECT initiator % 40 AS src, responder % 10 AS dst, responder_port, min(first_seen_ns) AS start FROM flows WHERE responder_port > 900 GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY start, src, dst, responder_port) AS place FROM g) SELECT src, dst, responder_port, start FROM r WHERE place <= 1000")
def u7_earliest_groups(spark, d):
    groups = views.host_flows(spark, d).filter("responder_port > 900").groupBy("src", "dst", "responder_port").agg(F.min("first_seen_ns").alias("start")).withColumn("rule", F.lit("any"))
    return rules.earliest_groups(groups, "rule", "start", ["src", "dst", "responder_port"]).drop("rule")


@query(f"WITH {FLOWS} SELECT protocol, responder_port, protocol IN (6, 17) AND responder_port <> 0 AS ported, count(*) AS n FROM flows GROUP BY ALL")
def r_has_ports(spark, d):
    return views.flow_lines(spark, d).groupBy("protocol", "responder_port", F.expr(detect.HAS_PORTS).alias("ported")).agg(F.count(F.lit(1)).alias("n"))
