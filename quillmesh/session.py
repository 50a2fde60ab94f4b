"""Where jobs keep intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session whose master is local may do without it; it gets a temporary
    folder. Elsewhere a machine-local folder would lose rows, so this raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
    made = tempfile.mkdtemp(prefix="quillmesh-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir() or made


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage of iterative jobs with data that survives lost executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def materialize_observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize`` with totals of the rows that are written, taken while they are: no second scan."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    stored = materialize(df.observe(seen, *metrics), name)
    return stored, seen.get


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in stored:
        if path := getattr(df, "stored_at", None):
            delete_path(df.sparkSession, path)


def discard_unheld(stored: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote once nobody holds its DataFrame; what was derived from it must be stored by then."""
    weakref.finalize(stored, delete_path, stored.sparkSession, stored.stored_at).atexit = False
