"""Micro-batch sink of the chunk index."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.session import delete_path, path_exists
from quillmesh.sources.index_store import current_view, latest_pending, write_batch

# Flush interval of the persistence queue.
FLUSH_INTERVAL = "30 seconds"


def start_sink(
    pending: DataFrame,
    path: str,
    checkpoint: str,
    *,
    order: str = "seq",
    interval: str | None = FLUSH_INTERVAL,
) -> StreamingQuery:
    """Write a stream of index rows to the log, last write per id in each batch.

    A batch goes to its own folder and is overwritten on retry, so a failed or
    repeated batch neither loses nor duplicates rows.  ``interval=None`` drains
    what is available and stops.  The size of a batch is set at the source
    (for files, ``maxFilesPerTrigger``).
    Rows are versioned by run, batch and ``order``.  A run is what shares a checkpoint: its
    stamp is stored there and names its folders, so a second stream, or one with a new checkpoint,
    adds to the log and overwrites nothing.  A flush that fails is noted beside the log before the
    error goes on.
    """
    spark = pending.sparkSession
    run = _run_of(spark, checkpoint)

    def flush(batch: DataFrame, batch_id: int) -> None:
        version = F.struct(F.lit(run).alias("run"), F.lit(batch_id).cast("bigint").alias("batch"), F.col(order).alias("seq"))
        rows = latest_pending(batch, order).withColumn("version", version).drop(order)
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        try:
            write_batch(rows, f"{path}/run={run}", batch_id)
        except Exception as e:
            note = batch.sparkSession.createDataFrame([(run, batch_id, str(e)[:500])], "run bigint, batch_id bigint, error string")
            note.write.mode("append").parquet(_failures(path))
            raise

    writer = pending.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """Current rows of the log."""
    return current_view(spark.read.parquet(path).drop("run", "batch_id"))


def sink_stats(spark: SparkSession, path: str) -> DataFrame:
    """Rows and batches flushed so far, and the flushes that failed."""
    log = spark.read.parquet(path)
    failed = spark.read.parquet(_failures(path)).count() if path_exists(spark, _failures(path)) else 0
    return log.agg(
        F.count(F.lit(1)).alias("total_flushed"), F.count_distinct("run", "batch_id").alias("flush_count")
    ).withColumn("failed_flushes", F.lit(failed).cast("bigint"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the log's current rows to ``target`` as a log of one batch, so that readers need not scan its history."""
    rows = current_view(spark.read.parquet(path).drop("run", "batch_id"))
    version = F.struct(F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("seq"))
    write_batch(rows.withColumn("version", version).withColumn("deleted", F.lit(False)), f"{target}/run=0", 0)


def clear(spark: SparkSession, path: str) -> None:
    """Delete a stored log with its notes of failures."""
    delete_path(spark, path)
    delete_path(spark, _failures(path))


def _failures(path: str) -> str:
    return f"{path.rstrip('/')}_failed"


def _run_of(spark: SparkSession, checkpoint: str) -> int:
    """The stamp of the run that a checkpoint belongs to, made at its first start."""
    at = f"{checkpoint.rstrip('/')}_run"
    if not path_exists(spark, at):
        spark.createDataFrame([(time.time_ns() // 1000,)], "run bigint").write.parquet(at)
    return spark.read.parquet(at).first()["run"]
