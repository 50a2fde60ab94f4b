"""Recommendations for paragraphs as they are finished."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators.search import search_notes
from quillmesh.streaming.paragraphs import RECOMMEND_LIMIT, debounce_stream


def recommend(paragraphs: DataFrame, index: DataFrame, embed: Callable[[Column], Column], limit: int = RECOMMEND_LIMIT) -> DataFrame:
    """Finished paragraphs -> their best notes, keyed by editor and time."""
    key = F.concat_ws("@", F.col("editor_id").cast("string"), F.unix_micros("ts").cast("string"))
    queries = paragraphs.select(
        key.alias("query_id"), embed(F.col("paragraph")).alias("query_vec"), F.lit(None).cast("string").alias("exclude_path")
    )
    return search_notes(queries, index, limit)


def start_recommender(
    events: DataFrame,
    index: Callable[[], DataFrame],
    embed: Callable[[Column], Column],
    path: str,
    checkpoint: str,
    *,
    limit: int = RECOMMEND_LIMIT,
    interval: str | None = None,
    **debounce_options,
) -> StreamingQuery:
    """Stream of editor changes -> tables ``paragraphs`` and ``recommendations`` under ``path``.

    ``index`` is called per batch so that fresh index rows are seen.  The
    paragraphs of a batch are stored before they are searched, so the stateful
    part of the stream runs once; each batch overwrites its own folders, so a
    retry repeats nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = f"{path}/paragraphs/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(stored)
        found = batch.sparkSession.read.schema(batch.schema).parquet(stored)
        if found.isEmpty():
            return  # no paragraph, so no search over the index
        recommend(found, index(), embed, limit).write.mode("overwrite").parquet(
            f"{path}/recommendations/batch_id={batch_id}"
        )

    writer = (
        debounce_stream(events, **debounce_options)
        .writeStream.outputMode("append")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()
