"""Tables that cut lineage, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it is unset a local folder serves a local master; a cluster gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    base = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(base, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{base}")
    return f"file://{base}"


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's tables are."""
    return f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back; a lost executor costs no recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: all that came of them has been written."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path:
            _delete(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application; results that were not written or collected are lost."""
    _delete(spark, scratch_dir(spark))
