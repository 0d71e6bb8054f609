"""Tables that a long job writes between its steps, in the folder that every executor shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a temporary folder of this machine serves a local master;
    on a cluster each executor would write to its own disk, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "netloom-checkpoints")


def materialize(df: DataFrame, tag: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: what follows neither repeats it nor depends on the executors that made it.
    With ``by``, an int column, each of its values has a folder of its own, so that a filter on it reads no other.
    ``codec`` is the files' compression, the session's if not given."""
    path = f"{shared_dir(df.sparkSession)}/netloom-{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=codec)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[written] = path
    return written


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, wherever that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote; only for tables that no later plan reads."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            remove(table.sparkSession, path)
