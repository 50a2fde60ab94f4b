"""The index log as a table bucketed by chunk id.

All versions of a chunk lie in one bucket, so that the current rows come from an aggregation, and a join with
other tables of the same buckets, without an exchange of the log.  Compaction reads and writes bucket by bucket.

The table is external: its files lie at a path that all executors share, and ``open_log`` names them in any
session.  Rows have ``version``, any ordered type, and ``deleted``; a row that is appended twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.session import fresh_path, make_folder

BUCKETS = 64


def open_log(spark: SparkSession, name: str, path: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """Name the log at ``path`` (an empty one if nothing is there); ``schema`` is the DDL of its rows."""
    make_folder(spark, path)
    spark.sql(
        f"create table if not exists {name} ({schema}) using parquet "
        f"clustered by (chunk_id) sorted by (chunk_id) into {buckets} buckets location '{path}'"
    )
    return spark.table(name)


def _buckets(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"describe extended {name}").collect()
    return int(next(r["data_type"] for r in rows if r["col_name"] == "Num Buckets"))


def append(rows: DataFrame, name: str) -> None:
    """Append rows of the log's columns: one file per bucket, whatever the rows' partitioning was."""
    spark = rows.sparkSession
    rows = rows.select(*spark.table(name).columns)
    # the table's buckets are hashes of the id, as are these partitions
    rows.repartition(_buckets(spark, name), "chunk_id").write.insertInto(name)
    spark.catalog.refreshTable(name)


def append_upserts(rows: DataFrame, name: str, version: Column) -> None:
    append(rows.withColumn("version", version).withColumn("deleted", F.lit(False)), name)


def append_tombstones(ids: DataFrame, name: str, version: Column) -> None:
    log = ids.sparkSession.table(name)
    gone = ids.select("chunk_id").distinct()
    own = {"chunk_id": F.col("chunk_id"), "version": version, "deleted": F.lit(True)}
    types = {f.name: f.dataType for f in log.schema.fields}
    append(gone.select(*[own.get(c, F.lit(None)).cast(types[c]).alias(c) for c in log.columns]), name)


def current(spark: SparkSession, name: str) -> DataFrame:
    """Newest live row per chunk id."""
    log = spark.table(name)
    payload = [c for c in log.columns if c not in ("chunk_id", "version", "deleted")]
    newest = log.groupBy("chunk_id").agg(F.max_by(F.struct(*payload, "deleted"), "version").alias("r"))
    return newest.filter("not r.deleted").select("chunk_id", *[F.col(f"r.{c}").alias(c) for c in payload])


def compact(spark: SparkSession, name: str, version: Column) -> str:
    """Replace the log by its current rows, one sorted file per bucket; returns where the old files are.

    The new files are written elsewhere and the table is pointed to them at the end, so readers see the old log
    or the new one.  The old files stay for readers that have opened them; deleting them is the caller's.
    """
    log = spark.table(name)
    rows = current(spark, name).withColumn("version", version).withColumn("deleted", F.lit(False)).select(*log.columns)
    to, made = fresh_path(spark, "compacted"), f"{name}_compacted"
    writer = rows.write.format("parquet").bucketBy(_buckets(spark, name), "chunk_id").sortBy("chunk_id")
    writer.option("path", to).mode("overwrite").saveAsTable(made)
    spark.sql(f"drop table {made}")
    described = spark.sql(f"describe extended {name}").collect()
    before = next(r["data_type"] for r in described if r["col_name"] == "Location")
    spark.sql(f"alter table {name} set location '{to}'")
    spark.catalog.refreshTable(name)
    return before
