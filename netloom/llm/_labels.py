"""Labelled rows for the classifiers: folds by the CRC-32 of the id, and a bounded sample to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "utf-8")), F.lit(folds)).cast("int")


def labelled_sample(labels: DataFrame, label: str, limit: int, train: Column) -> DataFrame:
    """At most ``limit`` rows ``(doc_id, label)`` of the training fold, lowest hashes of the id first.

    Null ids and null labels are left out; an id with several labels counts with the greatest.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(train)
    once = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
