"""Tables between the jobs of one query: written once to the cluster's shared folder, read back by each later job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side of a join up to which it is broadcast; the callers' rows are of some tens of bytes.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder only where none is set (tests)."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            import tempfile

            shared = tempfile.mkdtemp(prefix="brevia-checkpoints-")
        sc.setCheckpointDir(shared)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


#: Folders of this driver's tables, until drop_all().
_written: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """df in the shared folder, by columns, so that later jobs read those they need; lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, which drop_all() deletes too."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_all(spark: SparkSession) -> None:
    """Deletes all tables that saved() has written; for when the results that read them are done with."""
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more than `most` rows; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
