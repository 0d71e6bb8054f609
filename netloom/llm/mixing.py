"""Mixing sources to target weights by Poisson replication.

Every document of a source gets a number of copies drawn from a Poisson distribution whose mean is
the source's target repetition rate, ``weight * target characters / characters of the source``.
The draw inverts the distribution at a uniform number hashed from seed, id and text, so it is
the same on any cluster and in any order. Copies get a hashed position and are dealt out by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

#: Source tables up to this many rate steps (8 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_STEPS = 250_000
#: A hot source is spread over this many join keys where the shuffle join is taken.
SALTS = 64


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5: the same in any engine."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_steps(rate: float) -> tuple[int, np.ndarray]:
    """The least count k of note, and P(X <= k), P(X <= k + 1), ... of a Poisson variable, as far as they differ from 0 and 1.

    A draw is k and the number of steps at or below a uniform number. The steps reach 12 standard deviations and 30
    counts to both sides, so their number follows the root of the rate: a tiny source of a large corpus may have a rate of
    a million. Probabilities are taken from logarithms, as exp(-rate) may be 0.
    """
    if not rate > 0:
        return 0, np.ones(1)
    reach = math.ceil(12.0 * math.sqrt(rate) + 30.0)
    k = np.arange(max(0, math.floor(rate) - reach), math.ceil(rate) + reach + 1)
    log_p = k * math.log(rate) - rate - np.array([math.lgamma(x + 1.0) for x in k.tolist()])
    return int(k[0]), np.cumsum(np.exp(log_p))


def _with_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        drawn = [poisson_steps(rate) for rate in batch.column("rate").to_pylist()]
        least = pa.array([k for k, _ in drawn], pa.int64())
        steps = pa.array([x.tolist() for _, x in drawn], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, least, steps], [*batch.schema.names, "least", "steps"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, budget: float) -> DataFrame:
    """One row per source (null is a source of its own): its size, target rate and Poisson steps."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size"))
    sizes = materialize(sizes, "mix-sizes")
    raw = F.pow(F.col("size"), F.lit(temperature))
    if weights is not None:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        raw = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("source", F.lit(""))), F.lit(0.0)) if pairs else F.lit(0.0)
    totals = sizes.agg(F.sum(raw).alias("raw_total"), F.sum("size").alias("size_total")).first()
    raw_total, size_total = totals["raw_total"] or 0.0, totals["size_total"] or 0.0
    share = raw / F.lit(raw_total) if raw_total > 0 else F.lit(0.0)
    rate = F.when(F.col("size") > 0, share * F.lit(budget * size_total) / F.col("size")).otherwise(F.lit(0.0))
    return sizes.select("source", "size", rate.alias("rate")).mapInArrow(_with_steps, "source string, size double, rate double, least bigint, steps array<double>")


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """Replicate documents so that sources approach their weights, in globally shuffled order.

    ``weights`` maps sources to target shares of characters (sources it lacks get none); without it
    a source's share follows ``size ** temperature``. ``budget`` is the target size as a multiple of the
    input. Returns the input's columns and ``copy`` (from 1), ``n_copies``, ``mix_key`` (hashed
    position; partitions are dealt out and sorted by it).

    Null sources form one source. A null text counts as empty, and a source of empty texts only
    gets no copies. Rows that are equal in id and text draw the same number and each is
    replicated. Extra columns pass through; an input column called ``copy``, ``n_copies`` or
    ``mix_key`` is replaced. An empty table gives an empty table.
    """
    docs = docs.drop("copy", "n_copies", "mix_key")
    rates = materialize(source_rates(docs, weights, temperature, budget), "mix-rates").select(F.col("source").alias("from"), "least", "steps")
    identity = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    # the input's row is one column, so that no name in it can clash
    drawn = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), identity.alias("identity"))
    drawn = drawn.withColumn("draw", unit_hash(seed, F.col("identity")))
    steps = rates.agg(F.sum(F.size("steps") + 8)).first()[0] or 0
    if steps <= BROADCAST_STEPS:
        drawn = drawn.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("from")))
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = drawn.withColumn("own", F.pmod(F.xxhash64("identity"), F.lit(SALTS)).cast("int"))
        drawn = drawn.join(salted, F.col("source").eqNullSafe(F.col("from")) & (F.col("own") == F.col("salt")))
    n = F.col("least") + F.size(F.filter("steps", lambda t: t <= F.col("draw")))
    drawn = drawn.select("row", "identity", n.cast("int").alias("n_copies")).filter("n_copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), "identity", F.col("copy").cast("string"))))
    return keyed.select("row", "copy", "n_copies", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key").select("row.*", "copy", "n_copies", "mix_key")
