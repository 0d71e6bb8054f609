"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, look_up, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` long pairs in, ``(u, root)`` out: every node with the smallest node it reaches.

    Each round links larger neighbours to a node's least one (large star), then smaller ones (small
    star); stars of depth one remain. Rounds grow with the logarithm of a path's length, and a round
    moves as many rows as there are edges. A star's centre is a hot key; its least neighbour comes from a
    pre-aggregated minimum, and the look-up of it leaves the rows where they are. Null ends and loops are
    ignored; repeated edges are one. A round's table is deleted when the next one is written.
    """
    links = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialize(links, "cc")
    state = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        # a link (u, v), u > v: v tells u its least neighbour
        large = materialize(look_up(links, least, "v").select("u", F.col("m").alias("v")).filter("u <> v").distinct(), "cc-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = look_up(large, down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(links, large)
        links = after
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select("u", F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
