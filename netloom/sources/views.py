"""Packet- and flow-shaped views of the test tables, and the columns that operators expect.

packets: packet_index, ts_ns, src, dst_port, protocol, original_length, tcp_flags
flows: flow_id, initiator, responder, initiator_port, responder_port, protocol, bytes_out, bytes_back, packets_total, first_seen_ns, last_seen_ns, state
wire: packets of both directions with addresses (see there)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The address of user 0 with IPv4.
FIRST_CLIENT = 10 << 24


def micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    protocol = F.when(kind == "view", 17).when(kind == "signup", 1).otherwise(6)
    flags = F.when(kind == "click", 2).when(kind == "purchase", 16).when(kind == "error", 4).otherwise(0)
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("packet_index"),
        (micros("ts") * 1000).alias("ts_ns"),
        F.col("user_id").alias("src"),
        F.get_json_object("props", "$.k").cast("int").alias("dst_port"),
        protocol.alias("protocol"),
        F.floor(F.col("value") * 100).cast("bigint").alias("original_length"),
        flags.alias("tcp_flags"),
    )


def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets of both directions between users and four servers: DNS, HTTP and TLS by server, ARP for the highest keys.

    packet_index, ts_ns, captured_length, original_length, src_ip, dst_ip, src_bin, dst_bin, src_port, dst_port, protocol, tcp_flags, seq,
    payload_length, fragment, dns_query, dns_response, dns_answer_ip, record_type, http_host, tls_sni, sender_ip, sender_mac, gratuitous
    """
    e = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("packet_index"),
        (micros("ts") * 1000).alias("ts_ns"),
        F.col("user_id").alias("u"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("event_type").alias("t"),
        F.floor(F.col("value") * 10).cast("bigint").alias("amount"),
    )
    arp, s, six = F.col("k") >= 92, F.col("k") % 4, F.col("u") % 7 == 0
    e = e.withColumns({"arp": arp, "s": s, "six": six, "back": F.col("t").isin("purchase", "error") | ((F.col("t") == "signup") & (F.col("k") % 2 == 1)), "udp": s == 1, "fragment": ~arp & (F.col("k") >= 90)})
    six_hex = F.concat(F.lit("20010DB8"), F.lpad(F.hex(F.shiftright(F.col("u") + 1, 16)), 8, "0"), F.lit("0" * 12), F.lpad(F.hex((F.col("u") + 1) % 65536), 4, "0"))
    client_ip = F.when(F.col("six"), F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("u") + 1)))).otherwise(F.concat_ws(".", F.lit("10.0"), F.floor(F.col("u") / 256).cast("string"), (F.col("u") % 256).cast("string")))
    # users beyond 16 bits: 10.1.0.0 and on, and 2001:db8:0:1:: and on, so that no two share an address
    client_bin = F.unhex(F.when(F.col("six"), six_hex).otherwise(F.lpad(F.hex(F.col("u") + FIRST_CLIENT), 8, "0")))
    server_ip = F.when(F.col("six"), F.concat(F.lit("2001:db8:1::"), (F.col("s") + 1).cast("string"))).otherwise(F.concat(F.lit("192.0.2."), (F.col("s") + 1).cast("string")))
    server_bin = F.unhex(F.when(F.col("six"), F.concat(F.lit("20010DB80001" + "0" * 16), F.lpad((F.col("s") + 1).cast("string"), 4, "0"))).otherwise(F.concat(F.lit("C000020"), (F.col("s") + 1).cast("string"))))
    port = F.when(F.col("udp"), 53).when(F.col("s") == 2, 80).otherwise(443)
    flags = F.when(F.col("t") == "click", 2).when(F.col("t") == "purchase", 18).when(F.col("t") == "view", 24).when(F.col("t") == "signup", 17).otherwise(4)
    payload = F.when(F.col("udp") | (F.col("t") == "view"), F.col("amount") % 1400).otherwise(0)
    name = F.when(F.col("k") % 10 == 1, F.substring(F.md5(F.concat_ws("-", F.col("u").cast("string"), F.col("k").cast("string"))), 1, 24)).otherwise(F.concat(F.lit("Host"), F.col("k").cast("string")))
    ip = lambda x: F.when(~F.col("arp"), x)
    whole = lambda x: F.when(~F.col("arp") & ~F.col("fragment"), x)
    dns = whole(F.when(F.col("udp"), F.lit(True)))
    e = e.withColumns({"client_ip": client_ip, "client_bin": client_bin, "server_ip": server_ip, "server_bin": server_bin, "port": port, "client_port": 1024 + F.col("u").cast("int") % 7})
    return e.select(
        "packet_index",
        "ts_ns",
        (ip(payload) + F.when(F.col("udp"), 42).otherwise(54)).alias("original_length"),
        F.least(ip(payload) + F.when(F.col("udp"), 42).otherwise(54), F.lit(512)).alias("captured_length"),
        *[ip(F.when(F.col("back"), F.col(f"{b}_{x}")).otherwise(F.col(f"{a}_{x}"))).alias(f"{side}_{x}") for side, a, b in (("src", "client", "server"), ("dst", "server", "client")) for x in ("ip", "bin")],
        whole(F.when(F.col("back"), F.col("port")).otherwise(F.col("client_port"))).alias("src_port"),
        whole(F.when(F.col("back"), F.col("client_port")).otherwise(F.col("port"))).alias("dst_port"),
        ip(F.when(F.col("udp"), 17).otherwise(6)).alias("protocol"),
        whole(F.when(~F.col("udp"), flags)).alias("tcp_flags"),
        F.floor(F.col("k") / 10).cast("int").alias("seq"),
        F.coalesce(whole(payload), F.lit(0)).alias("payload_length"),
        F.col("fragment"),
        F.when(dns, F.concat(name, F.lit(".t"), (F.col("u") % 5).cast("string"), F.lit(".Example.com"))).alias("dns_query"),
        F.when(dns, F.col("back")).alias("dns_response"),
        F.when(dns & F.col("back"), F.concat(F.lit("192.0.2."), (F.col("u") % 4 + 1).cast("string"))).alias("dns_answer_ip"),
        F.when(dns, F.when(F.col("k") % 20 == 5, 16).otherwise(1)).alias("record_type"),
        whole(F.when((F.col("s") == 2) & (F.col("t") == "view"), F.concat(F.lit("www"), (F.col("k") % 5).cast("string"), F.lit(".example.org")))).alias("http_host"),
        whole(F.when((F.col("s").isin(0, 3)) & (F.col("t") == "view"), F.concat(F.lit("cdn"), (F.col("k") % 6).cast("string"), F.lit(".example.net")))).alias("tls_sni"),
        F.when(F.col("arp"), F.when(F.col("u") % 8 == 0, "0.0.0.0").otherwise(F.concat(F.lit("192.0.2."), (F.col("u") % 8).cast("string")))).alias("sender_ip"),
        F.when(F.col("arp"), F.concat(F.lit("02:00:00:00:00:0"), (F.col("u") % 3).cast("string"))).alias("sender_mac"),
        F.when(F.col("arp"), F.col("k") % 2 == 0).alias("gratuitous"),
    )


def client_text(ip: Column, address: Column) -> Column:
    """The text ``ip`` of an address as ``wire`` writes it: clients beyond 16 bits have their number in it, which no address text can hold."""
    part = lambda at, size: F.conv(F.hex(F.substring(address, at, size)), 16, 10).cast("bigint")
    four, six = part(1, 4) - FIRST_CLIENT, part(5, 4) * 65536 + part(15, 2)
    of_four = (F.octet_length(address) == 4) & four.between(65536, (192 << 24) - FIRST_CLIENT - 1)
    of_six = (F.octet_length(address) == 16) & part(5, 4).between(1, 65535)
    text = F.concat_ws(".", F.lit("10.0"), F.floor(four / 256).cast("string"), (four % 256).cast("string"))
    return F.when(of_four, text).when(of_six, F.concat(F.lit("2001:db8::"), F.lower(F.hex(six)))).otherwise(ip)


def flow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flows, without the initiator; ``with_initiator`` adds it from the order, which every line has."""
    state = F.when(F.col("l_returnflag") == "R", "reset").when(F.col("l_returnflag") == "A", "established").otherwise("syn_sent")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey"),
        # order key and line number make an id without a global sort
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("flow_id"),
        F.col("l_suppkey").alias("responder"),
        (F.col("l_partkey") % 1000).cast("int").alias("responder_port"),
        (1000 + F.col("l_partkey") % 300 * 7).cast("int").alias("initiator_port"),
        F.when(F.col("l_linestatus") == "O", 6).otherwise(17).alias("protocol"),
        F.floor(F.col("l_extendedprice") * 100).cast("bigint").alias("bytes_out"),
        F.floor(F.col("l_tax") * F.col("l_extendedprice")).cast("bigint").alias("bytes_back"),
        F.col("l_quantity").cast("bigint").alias("packets_total"),
        (micros("l_shipdate") * 1000).alias("first_seen_ns"),
        (micros("l_shipdate") * 1000 + F.col("l_quantity").cast("bigint") * 1_000_000_000).alias("last_seen_ns"),
        state.alias("state"),
    )


def with_initiator(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("initiator"))
    return lines.join(orders, "l_orderkey").drop("l_orderkey")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_initiator(spark, sf_dir, flow_lines(spark, sf_dir))


def host_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between 40 sources and 10 destinations, for rules by pair: ``src``, ``dst`` and the flow's columns.

    A reset flow carried payload if anything came back; UDP flows come from client ports."""
    paired = flows(spark, sf_dir)
    return paired.withColumns({"src": F.col("initiator") % 40, "dst": F.col("responder") % 10, "back_packets": F.when(F.col("state") == "syn_sent", 0).otherwise(1), "payload": F.col("bytes_back"), "port_of_protocol": F.col("protocol") * 65536 + F.col("responder_port"), "basis": F.when(F.col("protocol") == 6, "tcp_syn").otherwise("first_packet")})
