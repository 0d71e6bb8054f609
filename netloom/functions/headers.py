"""Packet headers of Ethernet frames as columns: fixed offsets, by built-in functions alone.

``decoded`` gives one row per frame. A header that doesn't fit stops it: ``truncated`` if the frame was cut when it was captured, else ``malformed``;
what isn't known is ``unsupported``. Payload bytes never leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookups

# Fixed values of the protocols.
VLAN_TYPES, ARP, IPV4, IPV6 = (0x8100, 0x88A8, 0x9100), 0x0806, 0x0800, 0x86DD
EXTENSIONS, FRAGMENT = (0, 43, 60), 44


def number(data: Column, at: Column | int, size: int) -> Column:
    """A big-endian number of up to seven bytes; null where the bytes end before it."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.octet_length(data) >= at + size, F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("bigint"))


def ones_sum(header: Column) -> Column:
    """The Internet checksum of a header with an even number of bytes: 0 where the one it holds is right."""
    words = F.sequence(F.lit(0), F.floor(F.octet_length(header) / 2).cast("int") - 1)
    fold = lambda t: t.bitwiseAND(65535) + F.shiftright(t, 16)
    # once the sum is one lambda's variable it isn't taken again wherever it stands
    once = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, i: a + number(header, i * 2, 2), fold)
    return F.element_at(F.transform(F.array(once), lambda t: F.lit(65535) - fold(t)), 1)


def address_text(address: Column) -> Column:
    """Dotted IPv4, or IPv6 in its shortest form: the first longest run of zero groups, of two at least, as two colons."""
    byte = lambda i: number(address, i, 1).cast("string")
    four = F.concat_ws(".", *[byte(i) for i in range(4)])
    groups = F.concat_ws(":", *[F.lower(F.conv(number(address, 2 * i, 2).cast("string"), 10, 16)) for i in range(8)])

    def shortest(g: Column) -> Column:
        out = g
        for n in range(2, 9):
            out = F.when(g.rlike(rf"(^|:)0(:0){{{n - 1}}}(:|$)"), F.regexp_replace(g, rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)", "$1::")).otherwise(out)
        return out

    six = F.element_at(F.transform(F.array(groups), shortest), 1)
    return F.when(F.octet_length(address) == 4, four).when(F.octet_length(address) == 16, six)


def mac_text(address: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.lower(F.hex(address)), "(..)", "$1:"), F.lit(":"))


def _settled(rows: DataFrame) -> DataFrame:
    """The same rows, through a generator, so that later steps read these columns and don't repeat the expressions that made them."""
    return rows.select(F.explode(F.array(F.struct("*"))).alias("row")).select("row.*")


def decoded(frames: DataFrame) -> DataFrame:
    """``frames`` (``packet_index``, ``data``, ``original_length``, ``link_type``; others pass through but ``data``) with their headers.

    Up to two VLAN tags, ARP, IPv4 with fragments and checksum, IPv6 with up to eight extension headers, TCP, UDP, ICMP and ICMPv6."""
    data = F.col("data")
    out = frames.withColumn("snapped", F.octet_length("data") < F.col("original_length"))
    first = number(data, 12, 2)
    second = F.when(first.isin(*VLAN_TYPES), number(data, 16, 2))
    tags = F.when(second.isin(*VLAN_TYPES), 2).when(first.isin(*VLAN_TYPES), 1).otherwise(0)
    out = _settled(out.withColumn("vlan_tags", tags))
    out = out.withColumn("ethertype", number(data, 12 + 4 * F.col("vlan_tags"), 2)).withColumn("l3", F.substring(data, 15 + 4 * F.col("vlan_tags"), F.lit(1 << 30)))
    out = _settled(out)
    l3, kind = F.col("l3"), F.col("ethertype")
    head = (number(l3, 0, 1).bitwiseAND(15) * 4).cast("int")
    out = out.withColumns(
        {
            "family": F.when(kind == IPV4, 4).when(kind == IPV6, 6),
            "head": F.when(kind == IPV4, head).when(kind == IPV6, 40),
            "ip_length": F.when(kind == IPV4, number(l3, 2, 2)).when(kind == IPV6, number(l3, 4, 2) + 40),
            "src_bin": F.when(kind == IPV4, F.substring(l3, 13, 4)).when(kind == IPV6, F.substring(l3, 9, 16)),
            "dst_bin": F.when(kind == IPV4, F.substring(l3, 17, 4)).when(kind == IPV6, F.substring(l3, 25, 16)),
            "fragment_word": F.when(kind == IPV4, number(l3, 6, 2)),
            "checksum_ok": F.when((kind == IPV4) & (head >= 20) & (F.octet_length(l3) >= head), ones_sum(F.substring(l3, F.lit(1), head)) == 0),
            "arp_operation": F.when(kind == ARP, number(l3, 6, 2)),
            "sender_mac": F.when((kind == ARP) & (number(l3, 0, 2) == 1), mac_text(F.substring(l3, 9, 6))),
            "sender_ip": F.when((kind == ARP) & (number(l3, 2, 2) == IPV4), address_text(F.substring(l3, 15, 4))),
            "target_ip": F.when((kind == ARP) & (number(l3, 2, 2) == IPV4), address_text(F.substring(l3, 25, 4))),
        }
    )
    out = _settled(out)
    # extension headers: the next header's number, where it begins, and whether a later fragment was met
    begin = F.struct(F.when(kind == IPV4, number(l3, 9, 1)).otherwise(number(l3, 6, 1)).alias("next"), F.col("head").cast("bigint").alias("at"), F.coalesce(F.col("fragment_word").bitwiseAND(0x1FFF) > 0, F.lit(False)).alias("part"), (F.col("fragment_word").bitwiseAND(0x1FFF) * 8).alias("offset"))

    def step(state: Column, _: Column) -> Column:
        skip, cut = state["next"].isin(*EXTENSIONS), state["next"] == FRAGMENT
        inner = (F.col("family") == 6) & ~state["part"]
        moved = F.when(inner & skip, state["at"] + (number(l3, state["at"] + 1, 1) + 1) * 8).when(inner & cut, state["at"] + 8).otherwise(state["at"])
        following = F.when(inner & (skip | cut), number(l3, state["at"], 1)).otherwise(state["next"])
        part = state["part"] | F.coalesce(inner & cut & (F.shiftright(number(l3, state["at"] + 2, 2), 3) > 0), F.lit(False))
        offset = F.when(inner & cut, F.shiftright(number(l3, state["at"] + 2, 2), 3) * 8).otherwise(state["offset"])
        return F.struct(following.alias("next"), moved.alias("at"), part.alias("part"), offset.alias("offset"))

    out = out.withColumn("walk", F.when(F.col("family").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(8)), begin, step)))
    out = _settled(out)
    out = out.withColumns({"protocol": F.col("walk.next").cast("int"), "l4": F.substring(l3, (F.col("walk.at") + 1).cast("int"), F.lit(1 << 30)), "fragment": F.coalesce("walk.part", F.lit(False)), "fragment_offset": F.col("walk.offset")})
    out = _settled(out)
    l4, whole = F.col("l4"), ~F.col("fragment")
    tcp, udp, icmp = (F.coalesce(whole & F.col("protocol").isin(*p), F.lit(False)) for p in ((6,), (17,), (1, 58)))
    room = F.col("ip_length") - F.col("walk.at")
    offset = F.shiftright(number(l4, 12, 1), 4) * 4
    echo = icmp & number(l4, 0, 1).isin(0, 8, 128, 129)
    out = out.withColumns(
        {
            "src_port": F.when(tcp | udp, number(l4, 0, 2)).cast("int"),
            "dst_port": F.when(tcp | udp, number(l4, 2, 2)).cast("int"),
            "seq": F.when(tcp, number(l4, 4, 4)),
            "tcp_ack": F.when(tcp, number(l4, 8, 4)),
            "tcp_header_length": F.when(tcp, offset).cast("int"),
            "tcp_flags": F.when(tcp, number(l4, 12, 2).bitwiseAND(0x1FF)).cast("int"),
            "tcp_window": F.when(tcp, number(l4, 14, 2)).cast("int"),
            "tcp_urgent": F.when(tcp, number(l4, 18, 2)).cast("int"),
            "payload_length": F.when(tcp, room - offset).when(udp, number(l4, 4, 2) - 8).cast("bigint"),
            "icmp_type": F.when(icmp, number(l4, 0, 1)).cast("int"),
            "icmp_code": F.when(icmp, number(l4, 1, 1)).cast("int"),
            "echo_id": F.when(echo, number(l4, 4, 2)).cast("int"),
            "echo_seq": F.when(echo, number(l4, 6, 2)).cast("int"),
        }
    )
    out = _settled(out)
    need = F.when(kind == ARP, 28).when(kind == IPV4, 20).when(kind == IPV6, 40)
    # extension headers that end behind the bytes, or whose length does
    cut = (F.col("family") == 6) & (F.col("walk.at").isNull() | (F.octet_length(l3) < F.col("walk.at")))
    short = cut | (F.octet_length(data) < 14) | (F.octet_length(l3) < need) | (F.octet_length(l3) < F.col("head")) | (F.octet_length(l4) < F.when(tcp, 20).when(udp, 8).when(icmp, 4))
    wrong = ((kind > 1500) & (kind < 0x0600)) | (F.col("head") < 20) | (F.col("ip_length") < F.col("head")) | (tcp & ((offset < 20) | (room < offset))) | (udp & ((number(l4, 4, 2) < 8) | (number(l4, 4, 2) > room))) | (F.shiftright(number(l3, 0, 1), 4) != F.col("family"))
    unknown = (F.col("link_type") != 1) | (kind <= 1500) | (kind.isin(*VLAN_TYPES)) | ~(kind.isin(ARP, IPV4, IPV6)) | (F.col("family").isNotNull() & whole & ~F.col("protocol").isin(1, 6, 17, 58, 59))
    says = lambda c: F.coalesce(c, F.lit(False))
    status = F.when(says(F.col("link_type") != 1), "unsupported").when(says(wrong), F.when(F.col("snapped"), "truncated").otherwise("malformed")).when(says(short), F.when(F.col("snapped"), "truncated").otherwise("malformed")).when(says(unknown), "unsupported").otherwise("complete")
    return out.withColumns({"decode_status": status, "src_ip": address_text(F.col("src_bin")), "dst_ip": address_text(F.col("dst_bin"))}).drop("data", "l3", "l4", "walk", "head", "fragment_word", "snapped")


def status_counts(rows: DataFrame) -> DataFrame:
    """``decode_status, packets, first_index`` of ``decoded`` rows; a status without packets has no row, and no packets give none."""
    return rows.groupBy("decode_status").agg(F.count("*").alias("packets"), F.min("packet_index").alias("first_index"))


def packet_info() -> Column:
    """One text a packet of ``decoded`` rows, of its last header: ports, flags, numbers and lengths, or who asks whom. What isn't decoded whole says how it ended.

    Application messages aren't decoded, so theirs is the text of the header below."""
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    c = F.col
    flags = F.array_join(lookups.tcp_flag_names(c("tcp_flags")), ",")
    tcp = text(c("src_port"), " -> ", c("dst_port"), " [", F.when(flags == "", "none").otherwise(flags), "] seq=", c("seq"), F.when(c("tcp_flags").bitwiseAND(16) != 0, text(" ack=", c("tcp_ack"))).otherwise(""), " win=", c("tcp_window"), " len=", c("payload_length"))
    udp = text(c("src_port"), " -> ", c("dst_port"), " len=", c("payload_length"))
    kind = F.when(c("protocol") == 1, lookups.icmp_type_name(c("icmp_type"))).otherwise(lookups.icmpv6_type_name(c("icmp_type")))
    icmp = text(F.coalesce(kind, text("type ", c("icmp_type"))), " code=", c("icmp_code"), F.coalesce(text(" id=", c("echo_id"), " seq=", c("echo_seq")), F.lit("")))
    name = F.coalesce(lookups.ip_protocol_name(c("protocol")), F.lit("unknown"))
    part = F.when(c("fragment_offset") > 0, text("fragment offset=", c("fragment_offset"), " ")).otherwise("")
    four = text(part, "protocol=", name, " (", c("protocol"), ")")
    six = F.when(c("fragment_offset") > 0, text(part, "next=", name)).otherwise(text("next=", name, " (", c("protocol"), ")"))
    asks = F.when((c("arp_operation") == 1) & c("target_ip").isNotNull() & c("sender_ip").isNotNull(), text("who-has ", c("target_ip"), " tell ", c("sender_ip")))
    asks = asks.when((c("arp_operation") == 2) & c("sender_ip").isNotNull(), text(c("sender_ip"), " is-at ", c("sender_mac"))).otherwise(text("ARP ", F.coalesce(lookups.arp_operation_name(c("arp_operation")), F.lit("operation"))))
    plain = F.when(c("ethertype") <= 1500, text("IEEE 802.3 frame, length ", c("ethertype"))).otherwise(text("EtherType 0x", F.lower(hexed(c("ethertype"), 2)), F.coalesce(text(" (", lookups.ethertype_name(c("ethertype")), ")"), F.lit(""))))
    whole = F.coalesce(F.when(c("tcp_flags").isNotNull(), tcp), F.when((c("protocol") == 17) & c("src_port").isNotNull(), udp), F.when(c("icmp_type").isNotNull(), icmp), F.when(c("family") == 4, four), F.when(c("family") == 6, six), F.when(c("ethertype") == ARP, asks), plain, F.lit(""))
    return F.when(c("decode_status") == "complete", whole).otherwise(F.concat(whole, F.when(whole == "", "").otherwise(" "), F.lit("["), c("decode_status"), F.lit("]")))


def hexed(value: Column, size: int) -> Column:
    """A number as ``size`` bytes, big-endian, in hexadecimal."""
    return F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")


def ethernet_frame(packets: DataFrame) -> DataFrame:
    """``packet_index, data, original_length, link_type``: frames of the wire's packets, with a zero for each payload byte."""
    zeros = F.repeat(F.lit("00"), F.col("payload_length").cast("int"))
    tcp = F.concat(hexed(F.col("src_port"), 2), hexed(F.col("dst_port"), 2), hexed(F.col("seq"), 4), F.lit("00000000"), hexed(F.col("tcp_flags") + 0x5000, 2), F.lit("FFFF00000000"))
    udp = F.concat(hexed(F.col("src_port"), 2), hexed(F.col("dst_port"), 2), hexed(F.col("payload_length") + 8, 2), F.lit("0000"))
    whole = F.concat(F.when(F.col("protocol") == 6, tcp).otherwise(udp), zeros)
    packets = _settled(packets.withColumn("segment", F.when(F.col("fragment"), F.repeat(F.lit("00"), 16)).otherwise(whole)))
    segment, length = F.col("segment"), F.length("segment") / 2
    ends = F.concat(F.hex("src_bin"), F.hex("dst_bin"))
    before = F.concat(F.lit("4500"), hexed(length + 20, 2), F.lit("0001"), F.when(F.col("fragment"), "0003").otherwise("0000"), F.lit("40"), hexed(F.col("protocol"), 1))
    packets = _settled(packets.withColumns({"before": before, "ends": ends}))
    four = F.concat("before", hexed(ones_sum(F.unhex(F.concat("before", F.lit("0000"), "ends"))), 2), "ends")
    part = F.when(F.col("fragment"), F.concat(hexed(F.col("protocol"), 1), F.lit("00001800000001"))).otherwise("")
    six = F.concat(F.lit("60000000"), hexed(length + F.length(part) / 2, 2), F.when(F.col("fragment"), "2C").otherwise(hexed(F.col("protocol"), 1)), F.lit("40"), "ends", part)
    ip = F.when(F.octet_length("src_bin") == 16, F.concat(F.lit("86DD"), six)).otherwise(F.concat(F.lit("0800"), four))
    octets = lambda c: F.array_join(F.transform(F.split(c, r"\."), lambda x: hexed(x.cast("int"), 1)), "")
    mac = F.upper(F.regexp_replace("sender_mac", ":", ""))
    arp = F.concat(F.lit("08060001080006040001"), mac, octets(F.col("sender_ip")), F.lit("000000000000"), octets(F.when(F.col("gratuitous"), F.col("sender_ip")).otherwise("192.0.2.99")))
    body = F.when(F.col("src_bin").isNull(), arp).otherwise(F.concat(ip, segment))
    whole = F.unhex(F.concat(F.lit("020000000001020000000002"), body))
    made = _settled(packets.select("packet_index", whole.alias("data")))
    return made.select("packet_index", "data", F.octet_length("data").cast("bigint").alias("original_length"), F.lit(1).alias("link_type"))
