"""Tables written to the shared folder, where a plan must read the same rows twice or be cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session on one machine that names no folder of its own, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a cluster without that setting is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_FALLBACK
    raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: rows keep the places they were written with, and a lost executor loses none."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/marginalia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
