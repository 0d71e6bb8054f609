"""Cut points of long jobs: tables written to the folder every executor shares, and joins that a hot key doesn't hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.stored import discard, materialize, shared_dir

__all__ = ["discard", "hot_keys", "look_up", "materialize", "release", "shared_dir"]


def release(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect: shuffle files of finished jobs go when their plans do, which may be long after."""
    spark._jvm.System.gc()


#: A key with more rows than this is looked up by broadcast, and that many such keys are at most.
HOT_ROWS, HOT_KEYS = 256, 500_000


def hot_keys(counts: DataFrame, most: int | None = None) -> DataFrame | None:
    """The keys of ``counts`` (key columns and ``__rows``) with over ``HOT_ROWS`` rows as a written table; None if there are none.

    Of more than ``most`` only those with the most rows, from a power of two on. Over ``most`` keys have more than half as
    many rows as any that is left out, so none of those holds more than about a ``most``-th of twice the rows."""
    most = HOT_KEYS if most is None else most
    hot = materialize(counts.filter(F.col("__rows") > HOT_ROWS), "hot")
    bits = hot.groupBy(F.length(F.bin("__rows")).alias("bits")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bits")).collect()
    known, least = 0, None
    for r in bits:  # 63 rows at most
        known += r["n"]
        if known > most:
            break
        least = 1 << (r["bits"] - 1)
    if least is None:
        discard(hot)
        return None
    return hot.filter(F.col("__rows") >= least).drop("__rows")


def look_up(rows: DataFrame, table: DataFrame, key: str | list[str], counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` of one row per key. Rows of hot keys stay where they are and meet a
    broadcast part of the table: a key is hot with over ``HOT_ROWS`` rows, so those parts are a small share of the rows, and
    ``HOT_KEYS`` rows at most (see ``hot_keys``). ``counts`` has the keys with ``__rows``, where they are known already."""
    keys = [key] if isinstance(key, str) else key
    hot = hot_keys(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")) if counts is None else counts)
    if hot is None:
        return rows.join(table, keys)
    few = table.join(F.broadcast(hot), keys, "left_semi")
    return rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys).unionByName(rows.join(F.broadcast(few), keys))
