"""A capture from packets to alerts: clock, flows, records and all twelve rules over one flow table that is written once."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import predicates
from netloom.stored import materialize

from . import detect, flows, rules
from .clock import TOLERANCE, clock_summary, clocked

SECOND = flows.SECOND
# What is internal, if nothing else is said.
PRIVATE = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "169.254.0.0/16", "127.0.0.0/8", "fc00::/7", "fe80::/10", "::1/128"]


@dataclass(frozen=True)
class Settings:
    """Times and thresholds of flows and rules; the defaults are those of a live network."""

    tcp_idle: int = flows.TCP_IDLE
    other_idle: int = flows.OTHER_IDLE
    linger: int = flows.FINISHED_LINGER
    tolerance: int = TOLERANCE
    width_ns: int = 60 * SECOND
    packet_width_ns: int = 60 * SECOND
    tunnel_width_ns: int = 300 * SECOND
    syn_ports: int = 20
    any_ports: int = 50
    hosts: int = 20
    failures: int = 30
    beacon: tuple[int, float, float] = (6, 10.0, 0.1)
    rare: tuple[int, int] = (50, 1)
    outbound: tuple[int, float] = (1_000_000, 10.0)
    cleartext_ports: list[int] = field(default_factory=lambda: rules.CLEARTEXT_PORTS)
    queries: int = 200
    tunnel: tuple[int, int] = (10, 30)
    names: dict = field(default_factory=dict)
    addresses: int = 2
    gratuitous: int = 20
    internal: list[str] = field(default_factory=lambda: PRIVATE)


@dataclass
class Analysis:
    """``packets`` with clock and flow, ``flows`` numbered from 1 in order of their first packet, with state and end, and ``alerts`` with citations; all are written tables."""

    packets: DataFrame
    flow_packets: DataFrame
    flows: DataFrame
    alerts: DataFrame

    def flows_with_alerts(self) -> DataFrame:
        return rules.with_alerts(self.flows, self.alerts)

    def summary(self, settings: Settings) -> DataFrame:
        """One row: totals of packets, flows and alerts, and what the rules left out."""
        of_rules = F.col("dns_query").isNotNull() | F.col("sender_ip").isNotNull()
        seen = self.packets.agg(F.count(F.lit(1)).alias("packets"), F.count_if(of_rules & F.col("ts_ns").isNull()).alias("packets_without_time"))
        times = clock_summary(self.packets)
        ended = self.flows.agg(F.count(F.lit(1)).alias("flows_evaluated"), F.count_if(F.col("first_seen_ns").isNull()).alias("flows_without_time"))
        raised = self.alerts.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
        raised = raised.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"), F.count_if(F.col("n") >= rules.PER_RULE).alias("rules_at_limit"))
        left_out = rules.not_evaluated(self.packets, detect.packet_rules(settings.packet_width_ns, settings.queries, settings.addresses, settings.gratuitous), "ts_ns", "packet_index")
        one = lambda t, c: t.select(c).scalar().alias(c)
        parts = [(times, "timestamp_outliers"), (times, "clock_jumps"), (ended, "flows_evaluated"), (ended, "flows_without_time"), (raised, "alerts"), (raised, "rules_at_limit"), (left_out, "events_not_evaluated")]
        return seen.select("*", *[one(t, c) for t, c in parts])


def host_rows(records: DataFrame) -> DataFrame:
    """Flow records as the flow rules read them."""
    return records.select(
        "flow_id",
        F.col("initiator_ip").alias("src"),
        F.col("responder_ip").alias("dst"),
        F.col("initiator_bin").alias("src_bin"),
        F.col("responder_bin").alias("dst_bin"),
        "protocol",
        "initiator_port",
        "responder_port",
        (F.col("protocol") * 65536 + F.col("responder_port")).alias("port_of_protocol"),
        "basis",
        F.col("tcp_state").alias("state"),
        (F.col("payload_initiator") + F.col("payload_responder")).alias("payload"),
        F.col("packets_responder").alias("back_packets"),
        F.col("bytes_initiator").alias("bytes_out"),
        F.col("bytes_responder").alias("bytes_back"),
        "first_seen_ns",
        "last_seen_ns",
    )


def within(address: Column, networks: list[str]) -> Column:
    found = F.lit(False)
    for network in networks:
        found = found | predicates.in_network(address, network)
    return F.coalesce(found, F.lit(False))


def analyse(packets: DataFrame, settings: Settings | None = None) -> Analysis:
    """All flows and alerts of a capture (``views.wire`` tells its columns). An empty capture has neither."""
    s = settings or Settings()
    table = clocked(packets, s.tolerance)
    walked = materialize(flows.flows_of(table, s.tcp_idle, s.other_idle, s.linger), "flowed")
    ended = flows.end_reasons(flows.flow_records(walked), flows.tcp_summary(walked), flows.epoch_ends(table), s.tcp_idle, s.other_idle, s.linger)
    ended = materialize(ended, "records")
    numbered = materialize(rules.flow_numbers(ended, "first_packet", "__range").withColumnRenamed("flow_number", "flow_id"), "flows")
    hosts = host_rows(numbered)
    internal, external = within(F.col("src_bin"), s.internal), ~within(F.col("dst_bin"), s.internal)
    four = detect.scan_rules(s.width_ns, s.syn_ports, s.any_ports, s.hosts, s.failures)
    volume, conflict, gratuitous = detect.packet_rules(s.packet_width_ns, s.queries, s.addresses, s.gratuitous)
    of_packets = lambda r: lambda: rules.window_alerts(table, r, "ts_ns", "packet_index", newest=False)
    makers = [lambda r=r: rules.window_alerts(hosts, r, "first_seen_ns", "flow_id", "last_seen_ns") for r in four]
    makers += [lambda: detect.beacons(hosts, *s.beacon), lambda: detect.rare_ports(hosts, *s.rare), lambda: detect.outbound_ratio(hosts, *s.outbound, internal, external), lambda: detect.cleartext(hosts, s.cleartext_ports)]
    makers += [of_packets(volume), lambda: detect.dns_tunnels(table, s.tunnel_width_ns, *s.tunnel, **s.names), of_packets(conflict), of_packets(gratuitous)]
    # rules don't depend on each other: their jobs run side by side, and each one's alerts are written before they are put together
    with ThreadPoolExecutor(len(makers)) as pool:
        found = list(pool.map(lambda make: materialize(make(), "rule-alerts"), makers))
    alerts = materialize(rules.numbered(found), "alerts")
    flow_of = walked.select("packet_index", "first_packet").join(numbered.select("first_packet", "flow_id"), "first_packet")
    cited = materialize(rules.with_citations(alerts, flow_of), "alerts")
    return Analysis(table, walked, numbered, cited)
