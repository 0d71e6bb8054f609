"""A store of captures: sessions, packets, flows and alerts as tables that are partitioned by session, and changes to them.

A change writes the partitions that it touches and no other file: Spark's dynamic overwrite puts a session's new rows in place of the old ones, and a
removal takes its folders away. Changes say what shall be, not what is to be done, so one that is repeated after a failure changes nothing more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.stored import discard, materialize, remove

from . import lists

TABLES = ("sessions", "packets", "flows", "alerts")


@dataclass(frozen=True)
class Store:
    """The tables under one folder of a file system that all executors share. ``session_id`` is a whole number of every row."""

    spark: SparkSession
    root: str

    def _path(self, table: str) -> str:
        if table not in TABLES:
            raise ValueError(f"no table {table}; there are {', '.join(TABLES)}")
        return f"{self.root.rstrip('/')}/{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._path(table))

    def put(self, table: str, rows: DataFrame) -> None:
        """Write the rows of whole sessions; a session that is there already is replaced, others stay as they are."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(self._path(table))

    def session(self, table: str, session_id: int) -> DataFrame:
        """One session's rows; only its folder is read."""
        return self.read(table).filter(F.col("session_id") == int(session_id))

    def set_alert_status(self, session_id: int, alert_id: int, status: str) -> int:
        """Give one alert of a session another status; how many rows had another one before. Nothing is written if none had."""
        own = self.session("alerts", session_id)
        changed = own.filter((F.col("alert_id") == alert_id) & ~F.col("status").eqNullSafe(F.lit(status))).count()
        after = lists.with_status(own, alert_id, status)
        if changed:
            # the folder that is read can't be the one that is written
            written = materialize(after, "alerts")
            self.put("alerts", written)
            discard(written)
        return changed

    def delete_sessions(self, session_ids: list[int]) -> None:
        """Take sessions away with all their packets, flows and alerts; the sessions' own rows go last, so that a broken removal can be found and repeated."""
        for table in reversed(TABLES):
            for session_id in session_ids:
                remove(self.spark, f"{self._path(table)}/session_id={int(session_id)}")

    def purge(self, at: str, now, days: int) -> list[int]:
        """Delete the sessions that are older than ``days`` at ``now`` and return their numbers, which are as many as there are sessions at most."""
        kept = lists.kept_after(self.read("sessions"), at, now, days).select("session_id")
        old = sorted(r["session_id"] for r in self.read("sessions").select("session_id").join(kept, "session_id", "left_anti").distinct().collect())
        self.delete_sessions(old)
        return old
