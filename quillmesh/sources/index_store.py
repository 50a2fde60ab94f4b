"""The chunk index as an append-only log of upserts and tombstones.

Each batch is one folder ``batch_id=N``; writing a batch again replaces it, so
retries are idempotent.  Readers see the newest row per chunk id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = ("content_vec", "summary_vec", "title_vec")


def as_upserts(rows: DataFrame, version: Column) -> DataFrame:
    return rows.withColumn("version", version).withColumn("deleted", F.lit(False))


def as_tombstones(index: DataFrame, ids: DataFrame, version: Column) -> DataFrame:
    """Deletion rows for the chunk ids, shaped like the index."""
    gone = ids.select("chunk_id").distinct()
    types = {f.name: f.dataType for f in index.schema.fields}
    cols = [
        F.col("chunk_id") if c == "chunk_id" else F.lit(None).cast(types[c]).alias(c) for c in index.columns
    ]
    return gone.select(*cols).withColumn("version", version).withColumn("deleted", F.lit(True))


def current_view(log: DataFrame) -> DataFrame:
    """Newest live row per chunk id; a (chunk id, version) pair occurs once.

    A narrow aggregation over ids, versions and tombstones finds the ids written
    more than once.  All other rows, normally almost the whole log, pass an
    anti-join untouched, so their vectors are neither sorted nor grouped, and
    need no shuffle while the list of rewritten ids is small enough to broadcast
    (Spark's own size threshold decides).
    """
    history = log.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("_writes"),
        F.max("version").alias("version"),
        F.max_by("deleted", "version").alias("_gone"),
    )
    touched = history.filter((F.col("_writes") > 1) | F.col("_gone"))
    single = log.join(touched.select("chunk_id"), "chunk_id", "left_anti")
    newest = log.join(touched.filter(~F.col("_gone")).select("chunk_id", "version"), ["chunk_id", "version"], "left_semi")
    return single.unionByName(newest).drop("version", "deleted")


def upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Index after an upsert of rows with distinct ids and the same columns."""
    kept = index.join(rows.select("chunk_id"), "chunk_id", "left_anti")
    return kept.select(*index.columns).unionByName(rows.select(*index.columns))


def delete_ids(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def delete_files(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.join(files.select("file_path"), "file_path", "left_anti")


def replace_files(index: DataFrame, rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Re-index whole files: their old chunks go, including stale numbers.

    ``files`` (file_path) lists the files that were re-indexed; one whose new text has no chunk
    loses its old ones.  Without the list the files of ``rows`` stand for it.
    """
    replaced = rows if files is None else files
    kept = delete_files(index, replaced.select("file_path").distinct())
    return kept.select(*index.columns).unionByName(rows.select(*index.columns))


def cleared(index: DataFrame) -> DataFrame:
    """Empty index of the same schema."""
    return index.limit(0)


def count_points(index: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Number of stored points: chunks and concepts together."""
    keys = index.select(F.lit(1).alias("one"))
    if concepts is not None:
        keys = keys.unionByName(concepts.select(F.lit(1).alias("one")))
    return keys.agg(F.count("one").alias("points"))


def index_stats(index: DataFrame) -> DataFrame:
    """Total, the estimate of one file per five chunks, and the exact file count."""
    return index.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.count_distinct("file_path").alias("files_exact"),
    ).withColumn("files_estimated", F.ceil(F.col("total_vectors") / F.lit(5)))


def legacy_expand(items: DataFrame, vector: str = "vector") -> DataFrame:
    """Single-vector rows -> the same vector under all three names."""
    return items.select("*", *[F.col(vector).alias(v) for v in VECTORS]).drop(vector)


def legacy_view(index: DataFrame) -> DataFrame:
    """Three-vector rows -> the content vector as the only one."""
    return index.withColumn("vector", F.col("content_vec")).drop(*VECTORS)


# ------------------------------------------------------------- pending rows


def latest_pending(pending: DataFrame, order: str = "seq") -> DataFrame:
    """Pending rows with one row per id, the last written."""
    payload = [c for c in pending.columns if c not in ("chunk_id", order)]
    return (
        pending.groupBy("chunk_id")
        .agg(F.max_by(F.struct(*payload), order).alias("r"), F.max(order).alias(order))
        .select("chunk_id", *[F.col(f"r.{c}").alias(c) for c in payload], order)
    )


def pending_of_files(pending: DataFrame, files: DataFrame) -> DataFrame:
    return pending.join(files.select("file_path"), "file_path", "left_semi")


def drop_pending_of_files(pending: DataFrame, files: DataFrame) -> DataFrame:
    return pending.join(files.select("file_path"), "file_path", "left_anti")


def flush_on_save(pending: DataFrame, path: str) -> DataFrame:
    """What a save of ``path`` flushes: all pending rows if the file has any, else none."""
    waiting = not pending.filter(F.col("file_path") == path).limit(1).isEmpty()
    return pending if waiting else pending.limit(0)


# ------------------------------------------------------------- files


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
