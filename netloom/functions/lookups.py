"""Names of numbers in packet headers. A number without a name gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names by number.
ETHERTYPES = {0x0800: "IPv4", 0x0806: "ARP", 0x0842: "Wake-on-LAN", 0x8035: "RARP", 0x8100: "802.1Q VLAN", 0x86DD: "IPv6", 0x8808: "Ethernet flow control", 0x8847: "MPLS unicast", 0x8848: "MPLS multicast", 0x8863: "PPPoE discovery", 0x8864: "PPPoE session", 0x888E: "EAPOL", 0x88A8: "802.1ad QinQ", 0x88CC: "LLDP", 0x88E5: "MACsec", 0x88F7: "PTP", 0x9100: "QinQ (legacy)"}
IP_PROTOCOLS = {0: "IPv6 Hop-by-Hop", 1: "ICMP", 2: "IGMP", 4: "IPv4-in-IP", 6: "TCP", 17: "UDP", 41: "IPv6-in-IP", 43: "IPv6 Routing", 44: "IPv6 Fragment", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 59: "IPv6 No Next Header", 60: "IPv6 Destination Options", 89: "OSPF", 103: "PIM", 112: "VRRP", 132: "SCTP", 135: "Mobility"}
ARP_OPERATIONS = {1: "request", 2: "reply", 3: "RARP request", 4: "RARP reply"}
ICMP_TYPES = {0: "echo reply", 3: "destination unreachable", 4: "source quench", 5: "redirect", 8: "echo request", 9: "router advertisement", 10: "router solicitation", 11: "time exceeded", 12: "parameter problem", 13: "timestamp request", 14: "timestamp reply"}
ICMPV6_TYPES = {1: "destination unreachable", 2: "packet too big", 3: "time exceeded", 4: "parameter problem", 128: "echo request", 129: "echo reply", 130: "multicast listener query", 131: "multicast listener report", 132: "multicast listener done", 133: "router solicitation", 134: "router advertisement", 135: "neighbor solicitation", 136: "neighbor advertisement", 137: "redirect", 143: "multicast listener report v2"}
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 65: "HTTPS", 255: "ANY"}
TCP_FLAGS = {1: "FIN", 2: "SYN", 4: "RST", 8: "PSH", 16: "ACK", 32: "URG", 64: "ECE", 128: "CWR", 256: "AE"}


def _named(table: dict[int, str], number: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), number.cast("int"))


def ethertype_name(number: Column) -> Column:
    return _named(ETHERTYPES, number)


def ip_protocol_name(number: Column) -> Column:
    return _named(IP_PROTOCOLS, number)


def arp_operation_name(number: Column) -> Column:
    return _named(ARP_OPERATIONS, number)


def icmp_type_name(number: Column) -> Column:
    return _named(ICMP_TYPES, number)


def icmpv6_type_name(number: Column) -> Column:
    return _named(ICMPV6_TYPES, number)


def dns_type_name(number: Column) -> Column:
    return _named(DNS_TYPES, number)


def tcp_flag_names(flags: Column) -> Column:
    """Names of the flags that are set, lowest bit first."""
    return F.array_compact(F.array(*[F.when(flags.bitwiseAND(bit) != 0, name) for bit, name in TCP_FLAGS.items()]))
