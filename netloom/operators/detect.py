"""Detection rules over groups of flows, and over packets with names or hardware addresses. All give alerts (``rules.ALERT``).

Flow rules read src, dst, protocol, initiator_port, responder_port, basis, state, back_packets, bytes_out, bytes_back, first_seen_ns, last_seen_ns, flow_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.text import entropy

from netloom.stored import materialize

from . import rules
from .clock import rule_clock
from .ranges import carry
from .rules import WindowRule, cited_groups, evidence, group_times, shaped, small
from .windows import cited, sliding_count, sliding_distinct

HAS_PORTS = "(protocol IN (6, 17) AND responder_port <> 0)"
#: Never answered, or refused before any data moved.
FAILED = "(protocol = 6 AND basis = 'tcp_syn' AND (state = 'syn_sent' OR (state = 'reset' AND payload = 0)))"
ANSWERED = f"(back_packets > 0 AND NOT {FAILED})"


def scan_rules(width_ns: int, ports: int, any_ports: int, hosts: int, failures: int) -> list[WindowRule]:
    """The four windowed rules over flows, with the thresholds given."""
    return [
        WindowRule("scan_syn", FAILED, ("src", "dst"), "responder_port", width_ns, ports, "src", "dst", None, "distinct_ports_unanswered_or_refused"),
        WindowRule("scan_ports", HAS_PORTS, ("src", "dst"), "port_of_protocol", width_ns, any_ports, "src", "dst", None, "distinct_destination_ports"),
        WindowRule("scan_hosts", f"{HAS_PORTS} AND NOT {ANSWERED}", ("src", "protocol", "responder_port"), "dst", width_ns, hosts, "src", None, "responder_port", "distinct_hosts_unanswered_or_refused"),
        WindowRule("tcp_fail", FAILED, ("src",), None, width_ns, failures, "src", None, None, "failed_connection_attempts"),
    ]


def packet_rules(width_ns: int, queries: int, addresses: int, gratuitous: int) -> list[WindowRule]:
    """The windowed rules over packets: DNS query volume of a client, several hardware addresses of one IP address, gratuitous ARP."""
    return [
        WindowRule("dns_volume", "dns_query IS NOT NULL AND NOT dns_response AND src_ip IS NOT NULL", ("src_ip",), None, width_ns, queries, "src_ip", None, None, "queries_in_window"),
        WindowRule("arp_conflict", "sender_ip IS NOT NULL AND sender_ip <> '0.0.0.0'", ("sender_ip",), "sender_mac", width_ns, addresses, "sender_ip", None, None, "mac_addresses_in_window"),
        WindowRule("arp_gratuitous", "gratuitous AND sender_ip <> '0.0.0.0'", ("sender_mac",), None, width_ns, gratuitous, "sender_mac", None, None, "gratuitous_arp_in_window"),
    ]


#: Flows of a group that are put side by side; larger groups are cut.
HELD = 65_536


def beacons(flows: DataFrame, min_flows: int, min_mean_s: float, max_jitter: float, held: int = HELD) -> DataFrame:
    """Pairs and ports whose flows start evenly spaced: pop-stddev / mean of the intervals at most ``max_jitter``."""
    key = ["src", "dst", "protocol", "responder_port"]
    ported = flows.filter(HAS_PORTS).filter("first_seen_ns IS NOT NULL")
    ported = materialize(ported.select(*key, "first_seen_ns", "last_seen_ns", "flow_id"), "beacon-rows")
    # most groups are too small; they are left out before anything is sorted
    counts = materialize(ported.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(min_flows, 3)), "beacon-keys")

    def spaced(rows: DataFrame, before: Column) -> DataFrame:
        # the first flow of a group has no interval
        gap = F.when(before.isNotNull(), F.greatest(F.col("first_seen_ns") / 1e9 - before / 1e9, F.lit(0.0)))
        groups = rows.withColumn("gap", gap).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("stddev"), *group_times())
        return groups.filter((F.col("mean") >= min_mean_s) & (F.col("mean") > 0)).withColumn("jitter", F.try_divide("stddev", "mean")).filter(F.col("jitter") <= max_jitter)

    earlier = lambda *part: F.lag("first_seen_ns").over(Window.partitionBy(*key, *part).orderBy("first_seen_ns", "flow_id"))
    steady = spaced(ported.join(counts.filter(F.col("n") <= held).select(*key), key, "left_semi"), earlier())
    large = counts.filter(F.col("n") > held).select(*key)
    some_large = not large.isEmpty()
    if some_large:
        # large groups are cut by time, each part is told the last start of those before it; they are no more than a ``held``-th of the rows
        rows = ported.join(F.broadcast(large), key, "left_semi").withColumn("part", F.expr(f"first_seen_ns DIV {1 << 50}"))
        steady = steady.unionByName(spaced(carry(rows, key, "part", handed=(F.max, F.col("first_seen_ns"))), F.coalesce(earlier("part"), "handed")))
    steady = materialize(steady, "beacon-groups")
    confidence = F.when((F.col("n") >= 2 * max(min_flows, 3)) & (F.col("jitter") <= max_jitter / 2), "high").otherwise("medium")
    facts = evidence(connections=F.col("n"), mean_interval_seconds=F.round("mean", 3), interval_stddev_seconds=F.round("stddev", 3), jitter_ratio=F.round("jitter", 3))
    cites = cited_groups(ported.join(steady.filter(F.col("n") <= held).select(*key), key, "left_semi"), key, salts=1)
    if some_large:
        cites = cites.unionByName(cited_groups(ported.join(F.broadcast(steady.filter(F.col("n") > held).select(*key)), key, "left_semi"), key))
    steady = steady.join(cites, key)
    return shaped(steady.withColumns({"confidence": confidence, "evidence": facts, "source": F.col("src"), "destination": F.col("dst"), "destination_port": F.col("responder_port")}), "beacon")


def rare_ports(flows: DataFrame, min_flows: int, max_uses: int) -> DataFrame:
    """Ports used at most ``max_uses`` times by flows whose direction is known, answered by any, when ``min_flows`` flows have ports."""
    ported = flows.filter(HAS_PORTS)
    known = F.when(F.col("protocol") == 17, (F.col("initiator_port") >= 1024) & ~F.col("initiator_port").isin(rules.COMMON_PORTS)).otherwise(F.col("basis") != "first_packet")
    # a row a port, written once; flows are read again for the rare ports alone, which a semi-join finds before their other columns are joined
    ports = materialize(ported.groupBy("protocol", "responder_port").agg(F.count(F.lit(1)).alias("uses"), F.bool_and(known).alias("known"), F.bool_or(F.expr(ANSWERED)).alias("answered")), "ports")
    few = ports.filter((F.col("uses") <= max_uses) & F.col("known") & F.col("answered") & ~F.col("responder_port").isin(rules.COMMON_PORTS) & (F.col("responder_port") < rules.DYNAMIC_PORTS))
    total = ports.agg(F.coalesce(F.sum("uses"), F.lit(0))).scalar()
    key = ["protocol", "responder_port"]
    users = ported.join(F.broadcast(few.filter(total >= min_flows).select(*key)), key, "left_semi")
    users = materialize(users.select(*key, "src", "dst", "first_seen_ns", "last_seen_ns", "flow_id"), "rare-rows")
    groups = users.groupBy(*key).agg(F.count(F.lit(1)).alias("uses"), *group_times()).join(cited_groups(users, key, source="src", destination="dst"), key)
    facts = evidence(flows_to_port=F.col("uses"), protocol=F.when(F.col("protocol") == 6, "TCP").otherwise("UDP"), flows_in_capture=total)
    return shaped(groups.withColumns({"confidence": F.lit("low"), "destination_port": F.col("responder_port"), "evidence": facts}), "rare_port")


def outbound_ratio(flows: DataFrame, min_bytes: int, min_ratio: float, internal: Column, external: Column) -> DataFrame:
    """Pairs with flows from ``internal`` to ``external`` that send ``min_bytes`` and ``min_ratio`` times what comes back; nothing back passes."""
    ratio = F.try_divide(F.col("bytes_out").cast("double"), F.col("bytes_back"))
    large = flows.filter(internal & external & (F.col("bytes_out") >= min_bytes) & (ratio.isNull() | (ratio >= min_ratio))).withColumn("ratio", ratio)
    key = ["src", "dst"]
    groups = large.groupBy(*key).agg(F.count(F.lit(1)).alias("flows"), F.sum("bytes_out").alias("sent"), F.sum("bytes_back").alias("back"), F.min("ratio").alias("lowest"), *group_times()).join(cited_groups(large, key), key)
    confidence = F.when(F.col("sent") >= 10 * min_bytes, "high").otherwise("medium")
    facts = evidence(bytes_sent=F.col("sent"), bytes_received=F.col("back"), flows=F.col("flows"), lowest_flow_ratio=F.coalesce(F.round("lowest", 1).cast("string"), F.lit("no reply bytes")))
    return shaped(groups.withColumns({"confidence": confidence, "evidence": facts, "source": F.col("src"), "destination": F.col("dst")}), "outbound_ratio")


def cleartext(flows: DataFrame, ports: list[int] = rules.CLEARTEXT_PORTS) -> DataFrame:
    """Answered TCP flows to ports of unencrypted protocols, by pair and port."""
    key = ["src", "dst", "responder_port"]
    found = flows.filter(F.expr(f"protocol = 6 AND {ANSWERED}") & F.col("responder_port").isin(ports))
    groups = found.groupBy(*key).agg(F.count(F.lit(1)).alias("flows"), *group_times()).join(cited_groups(found, key), key)
    facts = evidence(destination_port=F.col("responder_port"), connections=F.col("flows"))
    return shaped(groups.withColumns({"confidence": F.lit("medium"), "evidence": facts, "source": F.col("src"), "destination": F.col("dst"), "destination_port": F.col("responder_port")}), "cleartext")


def suspicious_name(name: Column, record_type: Column, label: int = 40, whole: int = 100, bits: float = 3.8) -> Column:
    """A name that may carry data: a long label below the parent, a long name, a label of 16 or more with high entropy, or a type
    that answers with data (NULL, TXT)."""
    labels = F.split(rules.split_name(name)[1], r"\.")
    long = F.exists(labels, lambda x: F.octet_length(x) >= label) | (F.octet_length(name) >= whole)
    dense = F.exists(labels, lambda x: (F.octet_length(x) >= 16) & (entropy(x) >= bits))
    return F.coalesce(long | dense | record_type.isin(10, 16), F.lit(False))


def dns_tunnels(packets: DataFrame, width_ns: int, min_suspicious: int, min_subdomains: int, by_clock: bool = True, **limits: float) -> DataFrame:
    """Clients and parent domains with many suspicious queries, or many distinct subdomains of which the present one is suspicious; ``by_clock`` as of
    ``rules.window_alerts``.

    Subdomains are counted over all questions with three labels or more, suspicious ones by themselves; the rows of both meet by packet."""
    parent, sub = rules.split_name(F.col("dns_query"))
    asked = packets.filter("dns_query IS NOT NULL AND NOT dns_response AND src_ip IS NOT NULL").select("packet_index", "ts_ns", "src_ip", parent.alias("parent"), sub.alias("sub"), suspicious_name(F.col("dns_query"), F.col("record_type"), **limits).alias("suspicious")).filter("parent IS NOT NULL")
    key = ["src_ip", "parent"]
    whole = rule_clock(asked, "ts_ns", "packet_index", width_ns).filter("evaluated") if by_clock else materialize(asked.withColumn("epoch", F.lit(0).cast("bigint")), "asked")
    timed = [*key, "epoch"]
    enough = whole.groupBy(*timed).agg(F.count_if("suspicious").alias("s"), F.count(F.lit(1)).alias("n")).filter((F.col("s") >= min_suspicious) | ((F.col("n") >= min_subdomains) & (F.col("s") > 0)))
    asked = materialize(whole.join(enough.select(*timed), timed, "left_semi"), "asked")
    spread = sliding_distinct(asked, timed, "ts_ns", "sub", width_ns, "packet_index")
    counted = sliding_count(asked.filter("suspicious"), timed, "ts_ns", width_ns, "packet_index").select("packet_index", "n")
    both = materialize(spread.join(counted, "packet_index", "left").withColumn("n", F.coalesce("n", F.lit(0))), "tunnel-windows")
    by_count, by_spread = F.col("n") >= min_suspicious, (F.col("n_distinct") >= min_subdomains) & (F.col("n") > 0)
    first = both.filter(by_count | by_spread).groupBy(*key).agg(F.min(F.struct(F.col("epoch").alias("epoch"), F.col("ts_ns").alias("at"), F.col("packet_index").alias("id"), by_count.alias("by_count"), by_spread.alias("by_spread"))).alias("c"))
    first = small(first.select(*key, F.col("c.epoch").alias("in_epoch"), F.col("c.at").alias("crossed_ns"), F.col("c.id").alias("crossed"), "c.by_count", "c.by_spread"))
    later = F.struct("epoch", F.col("ts_ns").alias("a"), F.col("packet_index").alias("b")) >= F.struct(F.col("in_epoch").alias("epoch"), F.col("crossed_ns").alias("a"), F.col("crossed").alias("b"))
    peaks = both.join(first, key).filter(later).groupBy(*key).agg(F.max("n").alias("peak"), F.max("n_distinct").alias("peak_spread"), F.max("ts_ns").alias("last_ns"))
    # cited are the window's suspicious questions, then every question of the key
    grouped = cited(whole, first, key, "ts_ns", "packet_index", width_ns, newest=False, limit=rules.CITATIONS, of_window=F.col("suspicious"), epoch="epoch").drop("last_seen_ns")
    out = grouped.join(first, key).join(peaks, key)
    reached = F.when(F.col("by_count") & F.col("by_spread"), "both").when(F.col("by_spread"), "min_distinct_subdomains").otherwise("min_suspicious_queries")
    facts = evidence(parent_domain=F.col("parent"), suspicious_queries_in_window=F.col("peak"), distinct_subdomains_in_window=F.col("peak_spread"), threshold_reached=reached)
    shown = {"confidence": F.when(reached == "both", "high").otherwise("medium"), "evidence": facts, "source": F.concat_ws(" ", "src_ip", "parent"), "last_seen_ns": F.col("last_ns")}
    return shaped(out.withColumns(shown), "dns_tunnel")
