"""Typed display filters as Spark columns.

Comparisons never give null: a row whose field is null fails both ``==`` and ``!=``; ``negate`` of a
comparison does match it. Text is compared in lower case, and ``contains`` has no wildcards.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TCP, _UDP = "array_contains(protocols, 'tcp')", "array_contains(protocols, 'udp')"
_PORTED = "protocol IN (6, 17)"

# Fields of packets: type, columns (of two either may match) and, for some, what must hold beside.
PACKET_FIELDS = {
    "frame.number": ("number", ["packet_index"]), "frame.len": ("number", ["original_length"]), "frame.cap_len": ("number", ["captured_length"]),
    "ip.src": ("ip", ["src_bin"]), "ip.dst": ("ip", ["dst_bin"]), "ip.addr": ("ip", ["src_bin", "dst_bin"]), "ip.proto": ("number", ["protocol"]),
    "port": ("number", ["src_port", "dst_port"]), "tcp.port": ("number", ["src_port", "dst_port"], _TCP), "tcp.srcport": ("number", ["src_port"], _TCP), "tcp.dstport": ("number", ["dst_port"], _TCP),
    "udp.port": ("number", ["src_port", "dst_port"], _UDP), "udp.srcport": ("number", ["src_port"], _UDP), "udp.dstport": ("number", ["dst_port"], _UDP),
    "tcp.flags.fin": ("flag", ["(tcp_flags & 1) <> 0"]), "tcp.flags.syn": ("flag", ["(tcp_flags & 2) <> 0"]), "tcp.flags.rst": ("flag", ["(tcp_flags & 4) <> 0"]),
    "tcp.flags.psh": ("flag", ["(tcp_flags & 8) <> 0"]), "tcp.flags.ack": ("flag", ["(tcp_flags & 16) <> 0"]), "tcp.flags.urg": ("flag", ["(tcp_flags & 32) <> 0"]),
    "dns.qry.name": ("text", ["dns_query"]), "http.host": ("text", ["http_host"]), "tls.sni": ("text", ["tls_sni"]), "decode.status": ("complete truncated unsupported malformed", ["decode_status"]),
    "ip": ("flag", ["arrays_overlap(protocols, array('ipv4', 'ipv6'))"]),
    **{name: ("flag", [f"array_contains(protocols, '{name}')"]) for name in "ethernet arp ipv4 ipv6 icmp icmpv6 tcp udp dns dhcp http tls".split()},
}
# Fields of flows.
FLOW_FIELDS = {
    "flow.id": ("number", ["flow_id"]), "flow.initiator": ("ip", ["initiator_bin"]), "flow.responder": ("ip", ["responder_bin"]), "ip.addr": ("ip", ["initiator_bin", "responder_bin"]),
    "ip.version": ("number", ["ip_version"]), "ip.proto": ("number", ["protocol"]), "flow.initiator_port": ("number", ["initiator_port"]), "flow.responder_port": ("number", ["responder_port"]),
    "port": ("number", ["initiator_port", "responder_port"], _PORTED), "tcp.port": ("number", ["initiator_port", "responder_port"], "protocol = 6"), "udp.port": ("number", ["initiator_port", "responder_port"], "protocol = 17"),
    "flow.bytes": ("number", ["bytes_total"]), "flow.packets": ("number", ["packets_total"]), "flow.duration": ("decimal", ["duration_s"]),
    "flow.state": ("syn_sent syn_received established closing closed reset midstream", ["tcp_state"]), "flow.end_reason": ("tcp_finished idle_timeout capture_end evicted clock_reset", ["end_reason"]),
    "dns.qry.name": ("text", ["dns_query"]), "http.host": ("text", ["http_host"]), "tls.sni": ("text", ["tls_sni"]),
    "ipv4": ("flag", ["ip_version = 4"]), "ipv6": ("flag", ["ip_version = 6"]), "tcp": ("flag", ["protocol = 6"]), "udp": ("flag", ["protocol = 17"]), "icmp": ("flag", ["protocol = 1"]), "icmpv6": ("flag", ["protocol = 58"]),
    **{name: ("flag", [f"array_contains(application_protocols, '{name}')"]) for name in "dns dhcp http tls".split()},
    "alert": ("flag", ["alert_count > 0"]), "alert.count": ("number", ["alert_count"]), "alert.severity": ("low medium high", ["max_severity"]),
}
#: Fields of the views of line items and of events, whose hosts are numbers.
LINE_FIELDS = {"flow.addr": ("number", ["initiator", "responder"]), "flow.bytes": ("number", ["bytes_out"]), "port": ("number", ["responder_port"]), "flow.state": ("text", ["state"]), "tcp": ("flag", ["protocol = 6"]), "udp": ("flag", ["protocol = 17"])}
EVENT_FIELDS = {"ip.src": ("number", ["src"]), "port": ("number", ["dst_port"]), "frame.len": ("number", ["original_length"]), **{f"tcp.flags.{n}": ("flag", [f"protocol = 6 AND (tcp_flags & {bit}) <> 0"]) for n, bit in (("syn", 2), ("rst", 4), ("ack", 16))}, "tcp": ("flag", ["protocol = 6"]), "udp": ("flag", ["protocol = 17"])}
_ORDER = {"==", "!=", "<", "<=", ">", ">="}
#: Operators of each type; any other type is the list of an enumeration's words.
OPERATORS = {"number": _ORDER, "decimal": _ORDER, "text": {"==", "!=", "contains"}, "ip": {"==", "!="}, "flag": {"==", "!="}}


class FilterError(ValueError):
    """A filter that names no field, or compares one as its type doesn't allow."""


def present(fields: dict, name: str) -> Column:
    """A flag by itself: null is false."""
    kind, columns, guard = _field(fields, name)
    if kind != "flag":
        raise FilterError(f"{name} has a value; compare it")
    return F.coalesce(F.expr(columns[0]), F.lit(False))


def compare(fields: dict, name: str, operator: str, value: int | float | str | bool) -> Column:
    """A field against a value of its type. ``!=`` of two columns is that neither matches, and a null on either side fails it."""
    kind, columns, guard = _field(fields, name)
    words = kind.split() if kind not in OPERATORS else None
    if operator not in (OPERATORS["flag"] if words else OPERATORS[kind]):
        raise FilterError(f"{name} has no operator {operator}")
    _check(kind, words, value)
    base = "==" if operator == "!=" else operator
    if kind == "flag":
        match = F.expr(columns[0]) == F.lit(value)
    elif kind == "ip":
        match = reduce(lambda a, b: a | b, [in_network(F.col(c), str(value), keep_null=True) for c in columns])
    else:
        match = reduce(lambda a, b: a | b, [_leaf(F.col(c), base, value) for c in columns])
    if operator == "!=":
        match = ~match
    return F.coalesce(F.expr(guard) & match if guard else match, F.lit(False))


def _check(kind: str, words: list[str] | None, value: object) -> None:
    if words:
        if not isinstance(value, str) or value.lower() not in words:
            raise FilterError(f"{value!r} is none of {', '.join(words)}")
    elif kind == "ip":
        try:
            ipaddress.ip_network(str(value), strict=False)
        except ValueError:
            raise FilterError(f"{value!r} is no address or network") from None
    elif kind == "flag":
        if not isinstance(value, bool):
            raise FilterError(f"{value!r} is neither true nor false")
    elif kind == "text":
        if not isinstance(value, str):
            raise FilterError(f"{value!r} is no text")
    elif isinstance(value, bool) or not isinstance(value, int if kind == "number" else int | float) or value < 0:
        raise FilterError(f"{value!r} is no {kind} of 0 or more")


def negate(condition: Column) -> Column:
    return ~condition


def in_network(address: Column, network: str, keep_null: bool = False) -> Column:
    """Whether 4- or 16-byte addresses lie in a network; families never mix, host bits don't matter. A null address is false, or
    null with ``keep_null``."""
    block = ipaddress.ip_network(network, strict=False)
    low, high = F.lit(bytearray(block.network_address.packed)), F.lit(bytearray(block.broadcast_address.packed))
    within = (F.octet_length(address) == len(block.network_address.packed)) & address.between(low, high)
    return within if keep_null else F.coalesce(within, F.lit(False))


def _field(fields: dict, name: str) -> tuple[str, list[str], str | None]:
    try:
        kind, columns, *guard = fields[name.lower()]
    except KeyError:
        raise FilterError(f"unknown field {name}") from None
    return kind, columns, guard[0] if guard else None


def _leaf(column: Column, operator: str, value: int | float | str) -> Column:
    if isinstance(value, str):
        text, wanted = F.lower(column), F.lower(F.lit(value))
        return F.contains(text, wanted) if operator == "contains" else text == wanted
    return {"==": column == value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[operator]
