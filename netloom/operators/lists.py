"""Sorted, filtered and paged lists of stored tables, and changes to them as new tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.stored import materialize

MAX_PAGE, MAX_PER_PAGE = 1_000_000, 500

# The orders of each list; ties go by the identifier.
FLOW_SORTS = {"start": ["first_seen_ns", "first_packet"], "bytes": ["-bytes_total", "first_packet"], "packets": ["-packets_total", "first_packet"], "duration": ["-duration_s", "first_packet"]}
PACKET_SORTS = {"number": ["packet_index"], "newest": ["-packet_index"], "time": ["ts_ns", "packet_index"], "length": ["-original_length", "packet_index"]}
SESSION_SORTS = {"newest": ["-created_at", "-session_id"], "oldest": ["created_at", "session_id"], "packets": ["-packets", "-session_id"], "size": ["-bytes", "-session_id"]}
ALERT_SORTS = {"number": ["alert_id"], "severity": ["-severity_rank", "alert_id"], "newest": ["-first_seen_ns", "alert_id"]}
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3}


def sorted_by(rows: DataFrame, sorts: dict[str, list[str]], by: str) -> DataFrame:
    """Rows in one of the list's orders; a leading minus is descending, and nulls come last."""
    return rows.orderBy(*sort_order(sorts, by))


def sort_order(sorts: dict[str, list[str]], by: str) -> list[Column]:
    if by not in sorts:
        raise ValueError(f"no order {by}; there are {', '.join(sorts)}")
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in sorts[by]]


def check_page(number: int, size: int) -> None:
    if not 1 <= number <= MAX_PAGE or not 1 <= size <= MAX_PER_PAGE:
        raise ValueError(f"pages are 1 to {MAX_PAGE} and hold 1 to {MAX_PER_PAGE} rows")


def page(rows: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """One page of sorted rows, for the first pages: Spark keeps the first ``number * size`` rows of each task. ``page_index`` serves deep ones."""
    check_page(number, size)
    return rows.offset((number - 1) * size).limit(size)


@dataclass(frozen=True)
class PageIndex:
    """A sorted list cut into ranges: the written rows with their range, and how many rows each range has."""

    rows: DataFrame
    order: list[Column]
    counts: list[int]

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """One page, however deep: only the ranges that it lies in are read and sorted."""
        check_page(number, size)
        start, ends = (number - 1) * size, list(accumulate(self.counts))
        inside = [k for k, end in enumerate(ends) if end > start and end - self.counts[k] < start + size]
        before = ends[inside[0]] - self.counts[inside[0]] if inside else 0
        found = self.rows.filter(F.col("__part").isin(inside)) if inside else self.rows.filter(F.lit(False))
        return found.orderBy(*self.order).drop("__part").offset(start - before if inside else 0).limit(size)


def page_index(rows: DataFrame, sorts: dict[str, list[str]], by: str, ranges: int) -> PageIndex:
    """Rows in one of the list's orders, which must end in an identifier, dealt to ``ranges`` ranges of it and written, a folder for each, so that a page's range alone is read.

    The driver holds a count for each range; ``ranges`` is 10,000 at most."""
    if not 1 <= ranges <= 10_000:
        raise ValueError("1 to 10,000 ranges")
    order = sort_order(sorts, by)
    dealt = rows.repartitionByRange(ranges, *order).withColumn("__part", F.spark_partition_id())
    written = materialize(dealt, "pages", "__part")
    found = {r["__part"]: r["n"] for r in written.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    return PageIndex(written, order, [found.get(k, 0) for k in range(ranges)])


def labelled_pages(pages: dict[str, DataFrame]) -> DataFrame:
    """Several sorted pages as one table of ``sort``, ``place`` and the pages' columns; a page has 500 rows at most."""
    from pyspark.sql import Window

    numbered = [p.withColumn("__at", F.monotonically_increasing_id()).withColumn("sort", F.lit(by)) for by, p in pages.items()]
    rows = reduce(DataFrame.unionByName, [n.withColumn("place", F.row_number().over(Window.partitionBy("sort").orderBy("__at"))) for n in numbered])
    return rows.drop("__at")


def top_by(rows: DataFrame, orders: dict[str, Column], key: str, limit: int) -> DataFrame:
    """The first ``limit`` rows by each order (whole numbers, descending, ties by ``key``) as ``sort``, ``place`` and the key, in one pass.

    Each task keeps ``limit`` rows of an order before anything is shuffled. ``limit`` is 500 at most."""
    from pyspark.sql import Window

    if not 1 <= limit <= MAX_PER_PAGE:
        raise ValueError(f"1 to {MAX_PER_PAGE} rows")
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(name).alias("sort"), by.cast("bigint").alias("by")) for name, by in orders.items()])).alias("o"))
    place = F.row_number().over(Window.partitionBy("o.sort").orderBy(F.desc_nulls_last("o.by"), key))
    return each.withColumn("place", place).filter(F.col("place") <= limit).select(F.col("o.sort").alias("sort"), "place", key)


def equal_to(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns equal all given values; those that are None don't count."""
    return reduce(lambda df, kv: df.filter(F.col(kv[0]) == F.lit(kv[1])), [kv for kv in wanted.items() if kv[1] is not None], rows)


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), severity)


def with_status(alerts: DataFrame, alert_id: int, status: str) -> DataFrame:
    """The alerts with one's status changed; write it in place of the old table or partition."""
    if status not in ("open", "acknowledged", "closed"):
        raise ValueError(f"no status {status}")
    return alerts.withColumn("status", F.when(F.col("alert_id") == alert_id, status).otherwise(F.col("status")))


def kept_after(rows: DataFrame, at: str, now: Column, days: int | Column) -> DataFrame:
    """Rows no older than ``days``: what a purge keeps."""
    return rows.filter(F.col(at) >= now - F.make_dt_interval(days=F.lit(days) if isinstance(days, int) else days))


def without_session(tables: dict[str, DataFrame], session_id: int) -> dict[str, DataFrame]:
    """All tables without one session's rows."""
    return {name: df.filter(F.col("session_id") != session_id) for name, df in tables.items()}


def utc_text(ns: Column) -> Column:
    """Nanoseconds since 1970 as RFC 3339 in UTC with nine digits; null stays null."""
    part = F.pmod(ns, F.lit(1_000_000_000))
    day = F.date_format(F.timestamp_seconds(((ns - part) / 1_000_000_000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(day, F.lit("."), F.lpad(part.cast("string"), 9, "0"), F.lit("Z"))


def overview(sessions: DataFrame, alerts: DataFrame, key: str, newest: list[str]) -> DataFrame:
    """Totals, alerts by severity and by status, open alerts by severity, and the newest five sessions, as rows ``part, name, n``.

    Alerts are grouped once by both; all else is taken of that."""
    totals = sessions.agg(F.count(F.lit(1)).alias("captures"), F.coalesce(F.sum("packets"), F.lit(0)).cast("bigint").alias("packets"))
    rows = [totals.select(F.lit(part).alias("part"), F.lit("").alias("name"), F.col(part).alias("n")) for part in ("captures", "packets")]
    groups = alerts.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"))
    for part, column, kept in (("by_severity", "severity", groups), ("by_status", "status", groups), ("open_by_severity", "severity", groups.filter("status = 'open'"))):
        rows.append(kept.groupBy(column).agg(F.sum("n").alias("n")).select(F.lit(part).alias("part"), F.col(column).alias("name"), "n"))
    five = labelled_pages({"newest": page(sorted_by(sessions, {"newest": newest}, "newest"), 1, 5).select(key)})
    rows.append(five.select(F.lit("newest").alias("part"), F.col("place").cast("string").alias("name"), F.col(key).alias("n")))
    return reduce(DataFrame.unionByName, rows)
