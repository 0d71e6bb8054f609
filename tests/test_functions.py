import ipaddress
from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from netloom.functions import lookups, text
from netloom.functions import predicates as p


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def results(df, expression):
    return [r["y"] for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


TARGETS = {
    "http://u:p@ss@h.example/a": ("h.example", "/a"),
    "http://h.example/a;jsessionid=SECRET/b?q=1#f": ("h.example", "/a"),
    "http://u:pw?x@h.example/a": (None, None),
    "http://h.example?token=1": (None, None),
    "HTTPS://H.Example:8443": ("h.example:8443", "/"),
    "http://[2001:db8::1]:80/x": ("[2001:db8::1]:80", "/x"),
    "http://[zz]/x": (None, None),
    "ftp://h.example/a": (None, None),
    "//h.example/a": (None, None),
    "/plain/path?x": (None, "/plain/path"),
    "/fetch/http://u:secret@h/x": (None, "/fetch/{redacted}"),
    "/fetch/http://": (None, "/fetch/{redacted}"),
    "/fetch/http:/": (None, "/fetch/http:/"),
    "/reset/abcdef1234567890": (None, "/reset/{redacted}"),
    "/reset/abcdefabcdefabcd/me%40x": (None, "/reset/abcdefabcdefabcd/{redacted}"),
    "": (None, None),
    None: (None, None),
}


def test_targets_are_redacted(spark):
    df = column(spark, list(TARGETS))
    host, path = text.redact_target(F.col("x"))
    got = [(r["h"], r["p"]) for r in df.select("i", host.alias("h"), path.alias("p")).orderBy("i").collect()]
    assert dict(zip(TARGETS, got, strict=True)) == TARGETS


def test_ipv6_literals(spark):
    cases = ["::", "::1", "1::", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8", "::ffff:192.0.2.1", "::ffff:1.2.3.256", "1:2:3:4:5:6:1.2.3.4", "12345::", "1:::2", "g::1", "1::2::3", ""]

    def valid(x):
        try:
            return isinstance(ipaddress.ip_address(x), ipaddress.IPv6Address)
        except ValueError:
            return False

    got = results(column(spark, [f"[{c}]" for c in cases]), text.host_value(F.col("x")))
    assert [g is not None for g in got] == [valid(c) for c in cases]


def test_small_text_functions(spark):
    assert results(column(spark, ["ab\x00c\x7f", "abcdef", "ä"]), text.printable(F.col("x"), 5)) == ["ab?c?", "abcde", "?"]
    assert results(column(spark, ["Cookie", "x-api-key", "accept"]), text.is_sensitive_header(F.col("x"))) == [True, True, False]
    assert results(column(spark, [0x0A0A, 0xFAFA, 0x0A1A, 0x1301], "int"), text.is_grease(F.col("x"))) == [True, True, False, False]
    bits = lambda b: -sum(n / len(b) * log2(n / len(b)) for n in Counter(b).values()) if b else 0.0
    cases = ["", "aaaa", "abcd", "ääé", "a1b2c3d4"]
    assert results(column(spark, cases), F.round(text.entropy(F.col("x")), 9)) == [round(bits(c.encode()), 9) for c in cases]
    assert results(column(spark, [2, 18, 256, None], "int"), F.array_join(lookups.tcp_flag_names(F.col("x")), "+")) == ["SYN", "SYN+ACK", "AE", ""]
    assert results(column(spark, [0x0806, 5], "int"), lookups.ethertype_name(F.col("x"))) == ["ARP", None]


def test_filters_and_their_errors(spark):
    f, g = p.PACKET_FIELDS, p.FLOW_FIELDS
    assert (len(f), len(g)) == (37, 32)
    for fields, name, operator, value in [(f, "nosuch", "==", 1), (f, "frame.len", "contains", 1), (f, "frame.len", "==", "x"), (f, "frame.len", "==", -1), (f, "frame.len", "==", True), (f, "http.host", "<", "x"), (f, "ip.src", "==", "300.1.1.1"), (f, "ip.src", "<", "10.0.0.1"), (g, "flow.state", "==", "open"), (g, "flow.state", "<", "closed"), (g, "alert", "==", 1), (g, "flow.duration", "==", "1")]:
        with pytest.raises(p.FilterError):
            p.compare(fields, name, operator, value)
    with pytest.raises(p.FilterError):
        p.present(f, "frame.len")
    rows = spark.createDataFrame([(1, bytes([10, 0, 0, 1]), bytes([10, 0, 1, 1]), 443, None), (2, bytes(15) + b"\1", None, None, 80), (3, None, None, None, None)], "i int, src_bin binary, dst_bin binary, src_port int, dst_port int").withColumn("protocols", F.array(F.lit("tcp")))
    kept = lambda c: {r["i"] for r in rows.filter(c).collect()}
    assert kept(p.compare(f, "ip.addr", "==", "10.0.1.0/24")) == {1}
    assert kept(p.compare(f, "ip.src", "!=", "10.0.0.0/8")) == {2}
    assert kept(p.negate(p.compare(f, "ip.src", "==", "10.0.0.0/8"))) == {2, 3}
    assert kept(p.compare(f, "port", "!=", 99)) == set() and kept(p.compare(f, "tcp.port", "==", 443)) == {1} and kept(p.compare(f, "udp.port", "==", 443)) == set()
    assert kept(p.compare(f, "ip.src", "==", "::/0")) == {2}
