"""Scalar functions on names and urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Headers whose values are never read.
SENSITIVE_HEADERS = ["authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key", "x-auth-token", "x-access-token", "x-csrf-token", "x-xsrf-token"]
MASK = "{redacted}"
#: host or [IPv6], with a port of up to five digits or none; the name's length is checked beside.
_HOST = r"^[A-Za-z0-9_-][A-Za-z0-9._-]*(:[0-9]{1,5})?$"
_GROUP = "[0-9A-Fa-f]{1,4}"
_DOTTED = r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"
#: An IPv6 literal: eight groups, or fewer around one gap; the last two may be a dotted IPv4 address.
_SIX = "^\\[(" + "|".join([rf"({_GROUP}:){{7}}{_GROUP}", rf"({_GROUP}:){{6}}{_DOTTED}", *[rf"({_GROUP}(:{_GROUP}){{0,{n}}})?::({_GROUP}(:{_GROUP}){{0,{5 - n}}})?" for n in range(6)], rf"({_GROUP}(:{_GROUP}){{0,6}})?::", rf"::{_GROUP}(:{_GROUP}){{0,6}}", rf"({_GROUP}(:{_GROUP}){{0,4}})?::({_GROUP}:)?{_DOTTED}"]) + ")\\](:[0-9]{1,5})?$"


def host_value(host: Column) -> Column:
    """A host with or without a port, in lower case; null for anything that isn't one."""
    name = F.substring_index(host, ":", 1)
    plain = host.rlike(_HOST) & (F.octet_length(name) <= 253)
    return F.when(plain | host.rlike(_SIX), F.lower(host))


def printable(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, with a question mark for each that isn't printable ASCII."""
    return F.substring(F.regexp_replace(text, r"[^\x20-\x7e]", "?"), 1, limit)


def redact_target(url: Column) -> tuple[Column, Column]:
    """Host and path of a url or path, as they may be shown: without user info, query, parameters and fragment, and with segments
    masked that look like secrets. Both are null where the target is withheld: other schemes, and authorities that aren't plainly a host."""
    absolute = url.rlike("^(?i)https?://")
    rest = F.regexp_replace(url, "^(?i)https?://", "")
    authority = F.substring_index(rest, "/", 1)
    host = F.when(absolute & ~authority.rlike("[?#]"), host_value(F.substring_index(authority, "@", -1)))
    origin = F.startswith(url, F.lit("/")) & ~F.startswith(url, F.lit("//"))
    tail = F.substring(rest, F.length(authority) + 1, F.length(rest))
    path = F.when(origin, url).when(host.isNotNull(), F.when(tail == "", "/").otherwise(tail))
    return host, mask_segments(F.regexp_replace(path, "(?s)[?#;].*$", ""))


def mask_segments(path: Column) -> Column:
    """Path segments that look like secrets become ``{redacted}``: 32 characters or more, 16 or more with letters and digits, or
    with an @. From an embedded url on (a scheme, then two slashes and more) all of the rest is one mask."""
    long = lambda x: (F.length(x) >= 32) | ((F.length(x) >= 16) & x.rlike("[A-Za-z]") & x.rlike("[0-9]")) | x.rlike("@|(?i)%40")
    embedded = F.regexp_replace(path, r"(^|/)[A-Za-z][A-Za-z0-9+.-]*://(?s).*$", "$1" + "\\{redacted\\}")
    return F.array_join(F.transform(F.split(embedded, "/"), lambda x: F.when(long(x), F.lit(MASK)).otherwise(x)), "/")


def is_sensitive_header(name: Column) -> Column:
    return F.lower(name).isin(SENSITIVE_HEADERS)


def is_grease(value: Column) -> Column:
    """Reserved values of TLS lists: both bytes equal, with the low half 0xA."""
    return (F.shiftright(value, 8) == value.bitwiseAND(255)) & (value.bitwiseAND(15) == 10)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a byte of the text's UTF-8; 0 for the empty text."""
    pairs = F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "utf-8")), "(..)", "$1 "), " "), lambda c: c != "")
    n = F.size(pairs).cast("double")
    share = lambda c: F.size(F.filter(pairs, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(pairs), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
