"""The recently used chunks that fit a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Size model of a cached chunk and the default budget.
BYTES_PER_CHAR = 2
BYTES_PER_NUMBER = 8
OVERHEAD_BYTES = 100
DEFAULT_BUDGET = 50 * 1024 * 1024

RANGES = 1024


def cached_size(content: Column, embedding: Column, metadata_json: Column) -> Column:
    return (
        F.length(content) * BYTES_PER_CHAR
        + F.size(embedding) * BYTES_PER_NUMBER
        + F.length(metadata_json) * BYTES_PER_CHAR
        + OVERHEAD_BYTES
    ).cast("bigint")


def hot_set(accesses: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Newest chunks whose running size stays within the budget; the newest is always kept.

    ``last_access`` is a unique counter.  The running size is a sum over ``RANGES`` equal ranges of the
    counter, newest first, plus a running sum inside each range, so no task orders the whole table.
    """
    sized = accesses.withColumn("cached_bytes", cached_size(F.col("content"), F.col("embedding"), F.col("metadata")))
    ends = accesses.agg(F.min("last_access").alias("_low"), F.max("last_access").alias("_high"))  # one row
    width = F.greatest(F.lit(1), F.ceil((F.col("_high") - F.col("_low") + 1) / RANGES))
    ranged = sized.join(F.broadcast(ends)).withColumn("_range", F.floor((F.col("_high") - F.col("last_access")) / width))
    # at most RANGES rows
    totals = ranged.groupBy("_range").agg(F.sum("cached_bytes").alias("_bytes"))
    newer = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_bytes").over(newer), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(F.desc("last_access")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.withColumn("_inside", F.sum("cached_bytes").over(within)).join(F.broadcast(offsets), "_range")
    fits = (F.col("_before") + F.col("_inside") <= budget) | (F.col("last_access") == F.col("_high"))
    return running.where(fits).select(*sized.columns)
