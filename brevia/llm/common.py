"""Helpers shared by the llm operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; a local one only where none is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        import tempfile

        shared = tempfile.mkdtemp(prefix="brevia-checkpoints-")
    sc.setCheckpointDir(shared)


def saved(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder and read back: lineage ends here."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that a job of this library wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as no column of df has (in any case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def one_line(sql: str) -> str:
    return re.sub(r"\s+", " ", sql).strip()
