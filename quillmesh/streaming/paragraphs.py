"""Finished paragraphs in editor changes: detection and debouncing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.text import trim_ws

# Shortest paragraph and quiet time of the application.
MIN_CHARS = 100
DEBOUNCE_MS = 1000
RECOMMEND_LIMIT = 5

SLICE_SECONDS = 3600


def finished_paragraph(content: Column, cursor: Column) -> Column:
    """Trimmed paragraph that a double line break just ended, else NULL."""
    ended = (cursor >= 2) & (F.substring(content, cursor - 1, F.lit(2)) == "\n\n")
    before = F.substring(content, F.lit(1), cursor - 2)
    return F.when(ended, trim_ws(F.substring_index(before, "\n\n", -1)))


def qualifies(paragraph: Column, min_chars: int = MIN_CHARS) -> Column:
    return F.coalesce((paragraph != "") & (F.length(paragraph) >= min_chars), F.lit(False))


def extract_paragraphs(events: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Qualifying changes with their paragraph; works on batches and streams."""
    out = events.withColumn("paragraph", finished_paragraph(F.col("content"), F.col("cursor")))
    return out.filter(qualifies(F.col("paragraph"), min_chars)).withColumn("char_count", F.length("paragraph"))


def _ties(arrival: str | None) -> list[str]:
    return [*([arrival] if arrival else []), "cursor", "paragraph"]


def debounce(
    events: DataFrame, min_chars: int = MIN_CHARS, debounce_ms: int = DEBOUNCE_MS, slice_seconds: int = SLICE_SECONDS,
    arrival: str | None = None,
) -> DataFrame:
    """Batch form: qualifying changes that no change follows within the quiet time.

    The follower of a change is looked up within slices of one editor's time
    line, so an editor with very many changes is spread over many tasks.  Each
    slice also sees the first change of the next one; a change further away than
    that is later than the quiet time in any case.  Changes of one instant count in the
    order of ``arrival`` (a column, where there is one), cursor and paragraph: the last of them stands.
    """
    if debounce_ms <= 0:
        return extract_paragraphs(events, min_chars)
    width = max(slice_seconds * 1_000_000, debounce_ms * 1000)
    slim = events.withColumn("paragraph", finished_paragraph(F.col("content"), F.col("cursor"))).drop("content")
    sliced = slim.withColumn("_slice", F.floor(F.unix_micros("ts") / F.lit(width)))
    firsts = events.select("editor_id", "ts", F.floor(F.unix_micros("ts") / F.lit(width)).alias("_slice"))
    firsts = firsts.groupBy("editor_id", "_slice").agg(F.min("ts").alias("ts")).withColumn("_slice", F.col("_slice") - 1)
    both = sliced.withColumn("_own", F.lit(True)).unionByName(
        firsts.withColumn("_own", F.lit(False)), allowMissingColumns=True
    )
    nxt = F.lead("ts").over(W.partitionBy("editor_id", "_slice").orderBy("ts", *_ties(arrival)))
    quiet = nxt.isNull() | (F.unix_micros(nxt) - F.unix_micros("ts") >= debounce_ms * 1000)
    out = both.withColumn("_quiet", quiet).filter("_own and _quiet").drop("_slice", "_own", "_quiet")
    return out.filter(qualifies(F.col("paragraph"), min_chars)).withColumn("char_count", F.length("paragraph"))


def debounce_stream(
    events: DataFrame, min_chars: int = MIN_CHARS, debounce_ms: int = DEBOUNCE_MS, watermark: str = "5 seconds",
    arrival: str | None = None,
) -> DataFrame:
    """Streaming form: the last change of every burst, if it finished a paragraph.

    A burst is a session whose gap is one microsecond below the quiet time, as
    changes exactly one quiet time apart do not cancel each other.  Only the
    extracted paragraph of the last change is kept in state, not the text.  Ties of one
    instant are as in ``debounce``.
    """
    if debounce_ms <= 0:
        return extract_paragraphs(events, min_chars)
    slim = events.select(
        "editor_id", "ts", "cursor", *([arrival] if arrival else []), finished_paragraph(F.col("content"), F.col("cursor")).alias("paragraph")
    )
    last = F.max_by(F.struct("ts", "cursor", "paragraph"), F.struct("ts", *_ties(arrival))).alias("last")
    bursts = (
        slim.withWatermark("ts", watermark)
        .groupBy("editor_id", F.session_window("ts", f"{debounce_ms * 1000 - 1} microseconds"))
        .agg(last)
    )
    out = bursts.select("editor_id", F.col("last.ts").alias("ts"), "last.cursor", "last.paragraph")
    return out.filter(qualifies(F.col("paragraph"), min_chars)).withColumn("char_count", F.length("paragraph"))
