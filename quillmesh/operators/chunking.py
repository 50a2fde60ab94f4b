"""Notes -> chunk rows, model spans and chunk payload rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import markdown as md
from quillmesh.functions import metadata as meta
from quillmesh.functions import spans as sp
from quillmesh.functions.text import built_once, is_blank, let, lines_of, numbered, or_else

# Chunk size used when indexing, and the summary stand-in length.
INDEX_CHUNK_CHARS = 500
SUMMARY_STAND_IN_CHARS = 200

CHUNK_FIELDS = ["content", "header_path", "start_pos", "end_pos", "start_line", "end_line"]


# The expressions of the jobs below, over the columns of those names.


@built_once
def _chunks(max_chars: int) -> Column:
    return md.chunks(F.col("content"), max_chars)


@built_once
def _cleaned() -> Column:
    return md.preprocess(F.col("content"))


@built_once
def _spans(max_chars: int) -> Column:
    return resolved_spans(F.coalesce(F.col("response"), F.lit("")), F.col("cleaned"), max_chars)


@built_once
def _cut() -> Column:
    return let(F.col("spans"), lambda s: sp.slice_spans(F.col("content"), s))


@built_once
def _metadata() -> Column:
    return meta.normalize_metadata(F.coalesce(F.col("response"), F.lit("")), F.col("content"))


def chunk_notes(notes: DataFrame, max_chars: int = INDEX_CHUNK_CHARS) -> DataFrame:
    """Rule-based chunks, one row each, numbered per note from 0."""
    found = notes.select("note_path", F.posexplode(_chunks(max_chars)).alias("index", "c"))
    return found.select("note_path", "index", *[F.col(f"c.{x}").alias(x) for x in CHUNK_FIELDS], F.col("c.path").alias("headers"))


def resolved_spans(answer: Column, cleaned: Column, max_chars: int = INDEX_CHUNK_CHARS) -> Column:
    """Merged model spans of a note, or its rule chunks when there are none."""
    none = F.array().cast(f"array<{sp.SPAN}>")

    def resolve(text: Column) -> Column:
        merged = sp.merge_spans(sp.parse_spans(answer, F.size(lines_of(text))))
        rules = sp.spans_from_chunks(md.chunks(text, max_chars))
        return F.when(is_blank(text), none).otherwise(
            let(merged, lambda m: F.when(F.size(m) > 0, m).otherwise(rules))
        )

    return let(cleaned, resolve)


def span_chunks(notes: DataFrame, answers: DataFrame, max_chars: int = INDEX_CHUNK_CHARS) -> DataFrame:
    """Chunks cut from the original text along spans found on the masked text.

    ``answers`` holds (note_path, response); a note without one falls back to
    the rules.  One join on the note path; everything else is a projection.
    """
    joined = notes.select("note_path", "content").join(
        answers.select("note_path", "response"), "note_path", "left"
    )
    # one step a projection: nested in a single expression they exceed the analyzer's iterations
    masked = joined.select("note_path", "content", "response", _cleaned().alias("cleaned"))
    found = masked.select("note_path", "content", _spans(max_chars).alias("spans"))
    cut = found.select("note_path", _cut().alias("cut"))
    rows = numbered(cut, "cut", "note_path", pos="index", item="c")
    return rows.select("note_path", "index", *[F.col(f"c.{x}").alias(x) for x in CHUNK_FIELDS])


def annotate_chunks(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Attach normalised metadata; ``answers`` holds (note_path, index, response)."""
    joined = chunks.join(answers.select("note_path", "index", "response"), ["note_path", "index"], "left")
    return joined.withColumn("metadata", _metadata()).drop("response")


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit("-chunk-"), index.cast("string"))


def chunk_payload(annotated: DataFrame, indexed_at: Column) -> DataFrame:
    """Index row without vectors; ``word_count`` counts characters."""
    m = F.col("metadata")
    not_empty = lambda x: F.coalesce(x, F.lit("")) != ""
    return annotated.select(
        chunk_id(F.col("note_path"), F.col("index")).alias("chunk_id"),
        F.col("note_path").alias("file_path"),
        "header_path",
        "start_line",
        "end_line",
        "content",
        m["summary"].alias("summary"),
        F.filter(F.concat(m["tags"], F.array(m["category"])), not_empty).alias("tags"),
        F.filter(F.transform(m["concepts"], lambda c: c["name"]), not_empty).alias("concepts"),
        F.lit("chunk").alias("type"),
        F.length("content").alias("word_count"),
        indexed_at.alias("indexed_at"),
    )


def with_embedding_texts(payload: DataFrame) -> DataFrame:
    """Add the three texts to embed for every chunk."""
    return payload.select(
        "*",
        F.col("content").alias("content_text"),
        or_else(F.col("summary"), F.substring("content", 1, SUMMARY_STAND_IN_CHARS)).alias("summary_text"),
        or_else(F.col("header_path"), F.col("file_path")).alias("title_text"),
    )


def embedding_inputs(payload: DataFrame) -> DataFrame:
    """The three texts alone, by chunk id."""
    return with_embedding_texts(payload).select("chunk_id", "content_text", "summary_text", "title_text")
