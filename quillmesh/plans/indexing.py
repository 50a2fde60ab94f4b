"""Indexing jobs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.chunking import (
    INDEX_CHUNK_CHARS,
    annotate_chunks,
    chunk_id,
    chunk_notes,
    chunk_payload,
    span_chunks,
    with_embedding_texts,
)
from quillmesh.operators.concepts import concept_rows, dedup_concepts
from quillmesh.operators.embedding import CHUNK_TEXTS, Embedder, embed_columns
from quillmesh.operators.notes import needs_reindex
from quillmesh.session import materialize, materialize_observed
from quillmesh.sources.index_store import replace_files


class Indexed(NamedTuple):
    """Index rows with their three vectors, the concepts found per note, the notes that failed, and totals.

    ``failed`` (note_path, error, failed_chunks): a note with a text that the embedder could not
    take writes neither rows nor concepts; the other notes are not affected.
    ``totals`` (notes, chunks, failed_chunks, concepts, characters) cover all that was embedded, failed notes
    included; they are observed by the pass that writes the chunks.
    """

    rows: DataFrame
    concepts: DataFrame
    failed: DataFrame
    totals: dict[str, int]


def _finish(chunks: DataFrame, answers: DataFrame, embedder: Embedder, indexed_at: Column) -> Indexed:
    # written once: both outputs and the list of failures read it
    annotated = materialize(annotate_chunks(chunks, answers), "annotated")
    texts = with_embedding_texts(chunk_payload(annotated, indexed_at))
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    embedded, totals = materialize_observed(
        embed_columns(texts, embedder, CHUNK_TEXTS, continue_on_error=True).drop(*CHUNK_TEXTS),
        "embedded",
        F.count_if(F.col("chunk_id") == chunk_id(F.col("file_path"), F.lit(0))).alias("notes"),
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("error").isNotNull()).alias("failed_chunks"),
        sum_of(F.size("concepts")).alias("concepts"),
        sum_of(F.col("word_count")).alias("characters"),
    )
    failed = (
        embedded.filter("error is not null")
        .groupBy(F.col("file_path").alias("note_path"))
        .agg(F.min("error").alias("error"), F.count("*").alias("failed_chunks"))
    )
    gone = failed.select(F.col("note_path").alias("file_path"))
    rows = embedded.join(gone, "file_path", "left_anti").select(*[c for c in embedded.columns if c != "error"])
    whole = annotated.join(failed.select("note_path"), "note_path", "left_anti")
    return Indexed(rows, dedup_concepts(concept_rows(whole), order=("index", "pos")), failed, totals)


def index_notes(
    notes: DataFrame, answers: DataFrame, embedder: Embedder, indexed_at: Column, max_chars: int = INDEX_CHUNK_CHARS
) -> Indexed:
    """Rule-based path: chunk, annotate, embed.

    ``answers`` holds the model's (note_path, index, response) per chunk.
    """
    return _finish(chunk_notes(notes, max_chars), answers, embedder, indexed_at)


def unified_index(
    notes: DataFrame,
    spans: DataFrame,
    answers: DataFrame,
    embedder: Embedder,
    indexed_at: Column,
    max_chars: int = INDEX_CHUNK_CHARS,
) -> Indexed:
    """Span path: mask, cut along model spans, annotate, embed, collect concepts."""
    return _finish(span_chunks(notes, spans, max_chars), answers, embedder, indexed_at)


def stale_notes(notes: DataFrame, note_state: DataFrame) -> DataFrame:
    """Notes that are new or changed since their index stamp."""
    joined = notes.join(note_state.select("note_path", "me_indexed_at"), "note_path", "left")
    return joined.filter(needs_reindex()).drop("me_indexed_at")


def refresh_index(index: DataFrame, rows: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """Index with all chunks of the re-indexed notes replaced.

    ``stale`` (note_path) are the notes that were re-indexed: it decides what goes, so a
    note edited to blank loses its chunks, and the chunk pipeline behind ``rows`` runs once.
    """
    files = None if stale is None else stale.select(F.col("note_path").alias("file_path"))
    return replace_files(index, rows, files)
