"""Flows of a packet stream: sessions by idle time, with a watermark for late packets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.stored import remove, shared_dir


def idle_sessions(packets: DataFrame, key: list[str], at: str, idle: str, late: str) -> DataFrame:
    """Sessions that end ``idle`` after their last packet. Packets later than ``late`` behind the newest time are dropped and counted
    in the query's progress; state is kept for open sessions alone."""
    watched = packets.withWatermark(at, late)
    sessions = watched.groupBy(*key, F.session_window(at, idle).alias("w")).agg(F.count(F.lit(1)).alias("packets"), F.sum("original_length").alias("bytes"))
    return sessions.select(*key, F.col("w.start").alias("first_seen"), F.col("w.end").alias("ends"), "packets", "bytes")


def run_once(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Everything that is there now through the stream, and the result as a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    place = f"{shared_dir(spark)}/netloom-stream-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # a batch written again after a failure replaces itself
        batch.write.mode("overwrite").parquet(f"{place}/rows" + ("" if mode == "complete" else f"/batch={number}"))

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(put).start()
    query.awaitTermination()
    remove(spark, f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/rows")
