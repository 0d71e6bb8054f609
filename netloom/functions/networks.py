"""Addresses against a table of networks: the longest prefix wins.

An address is two 64-bit numbers, an IPv4 one in the upper half of the first. It is masked once for each prefix length that the table has (33 and
129 at most), and meets the networks by equality, so no range is joined however many networks there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _half(address: Column, first: int) -> Column:
    return F.conv(F.substring(F.rpad(F.hex(address), 32, "0"), first, 16), 16, -10).cast("bigint")


def _mask(length: int) -> tuple[int, int]:
    bits = (((1 << 128) - 1) >> (128 - length) << (128 - length)) if length else 0
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(bits >> 64), signed(bits & ((1 << 64) - 1))


def with_network(rows: DataFrame, address: str, networks: DataFrame, name: str = "network") -> DataFrame:
    """Add ``name``, the longest of the ``networks`` (name, base, length: a 4- or 16-byte address and its prefix length) that holds the row's address.

    Families never mix and host bits of a base don't matter; of equal networks the least name counts. Null for a null address, one of another size, and
    where no network holds it. Every different address is looked up once."""
    base = networks.filter(F.octet_length("base").isin(4, 16) & F.col("length").between(0, 8 * F.octet_length("base")))
    base = base.select("name", F.octet_length("base").alias("family"), F.col("length").cast("int").alias("length"), _half(F.col("base"), 1).alias("hi"), _half(F.col("base"), 17).alias("lo"))
    lengths = sorted((r["family"], r["length"]) for r in base.select("family", "length").distinct().collect())  # 33 + 129 at most
    if not lengths:
        return rows.withColumn(name, F.lit(None).cast("string"))
    masks = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("length"), F.lit(_mask(n)[0]).cast("bigint").alias("hi"), F.lit(_mask(n)[1]).cast("bigint").alias("lo")) for f, n in lengths])
    masked = lambda t: [F.col("m.family").alias("family"), F.col("m.length").alias("length"), F.col(f"{t}hi").bitwiseAND(F.col("m.hi")).alias("hi"), F.col(f"{t}lo").bitwiseAND(F.col("m.lo")).alias("lo")]
    known = base.withColumn("m", F.explode(masks)).filter("m.family = family AND m.length = length").select("name", *masked(""))
    known = known.groupBy("family", "length", "hi", "lo").agg(F.min("name").alias("name"))
    seen = rows.select(F.col(address).alias("address")).filter(F.octet_length("address").isin(4, 16)).distinct()
    each = seen.select("address", F.octet_length("address").alias("own"), _half(F.col("address"), 1).alias("hi"), _half(F.col("address"), 17).alias("lo"))
    each = each.withColumn("m", F.explode(masks)).filter("m.family = own").select("address", *masked(""))
    held = each.join(known, ["family", "length", "hi", "lo"]).groupBy("address").agg(F.max_by("name", "length").alias("__network")).withColumnRenamed("address", "__address")
    return rows.join(held, F.col(address) == F.col("__address"), "left").withColumn(name, F.col("__network")).drop("__address", "__network")
