"""Running values per key that a hot key can't hold up: keys are cut into ranges, and ranges hand on their totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Packet indexes in a range.
SPAN = 1 << 20


def carry(rows: DataFrame, key: list[str], part: str, **totals: tuple[Callable[[Column], Column], Column]) -> DataFrame:
    """Add for every name in ``totals`` the aggregate ``(function, value)`` over all earlier ranges of the row's key; null in a key's first.

    Values are aggregated per range before anything is ordered: a range is one row. ``part`` and the key must not be null."""
    each = rows.groupBy(*key, part).agg(*[f(x).alias(n) for n, (f, x) in totals.items()])
    before = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    handed = each.select(*key, part, *[f(F.col(n)).over(before).alias(n) for n, (f, _) in totals.items()])
    return rows.join(handed, [*key, part])
