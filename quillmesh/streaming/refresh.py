"""Keeping an index fresh from a stream of note versions.

Notes are chunked by the rules inside the projection that reads them.  State per note holds the version it
was indexed at and a digest of every chunk, so that a new version emits only the chunks that changed and a
tombstone for each that is gone.  What is emitted goes through the caller's shaping (metadata, embeddings)
and into the index log, so unchanged chunks are never embedded again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quillmesh.functions import markdown as md
from quillmesh.operators.chunking import CHUNK_FIELDS, INDEX_CHUNK_CHARS
from quillmesh.streaming.sink import FLUSH_INTERVAL, start_sink

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = (
    "chunk_id string, file_path string, index int, content string, header_path string, start_pos int, end_pos int, "
    "start_line int, end_line int, seq bigint, deleted boolean"
)


def _processor(fields: list[str]) -> StatefulProcessor:
    # defined here so that tasks receive the class by value and executors need no installed package
    from pyspark.sql import Row

    change = Row("chunk_id", "file_path", "index", *fields, "seq", "deleted")

    class Changes(StatefulProcessor):
        def init(self, handle) -> None:
            self.indexed = handle.getValueState("indexed", "version bigint, digest string, chunks array<string>")

        def handleInputRows(self, key, rows, timerValues):
            newest = max(rows, key=lambda r: (r["version"], r["digest"]))
            held = self.indexed.get()
            version, digest, before = held if held is not None else (None, None, [])
            if version is not None and (newest["version"], newest["digest"]) <= (version, digest):
                return
            chunks = newest["chunks"] or []
            for i, chunk in enumerate(chunks):
                if i >= len(before) or before[i] != chunk["digest"]:
                    yield change(f"{key[0]}-chunk-{i}", key[0], i, *[chunk[f] for f in fields], newest["version"], False)
            for i in range(len(chunks), len(before)):
                yield change(f"{key[0]}-chunk-{i}", key[0], i, *[None for _ in fields], newest["version"], True)
            self.indexed.update((newest["version"], newest["digest"], [c["digest"] for c in chunks]))

        def close(self) -> None:
            pass

    return Changes()


def changed_chunks(notes: DataFrame, max_chars: int = INDEX_CHUNK_CHARS) -> DataFrame:
    """Stream of (note_path, content, version) -> changed chunks and tombstones.

    ``content`` NULL deletes the note; a note without text has no chunks.  Of several versions the greatest counts, in
    whatever order they come, and of one version the text of the greatest digest.  A deleted note keeps its
    version in state, so that a late older version does not bring it back.  Rows with a NULL path or version are ignored.
    The state store must be RocksDB (``start_refresh`` sees to it).
    """
    chunks = F.transform(
        md.chunks(F.col("content"), max_chars),
        lambda c: F.struct(*[c[f].alias(f) for f in CHUNK_FIELDS], F.md5(F.to_json(F.struct(*[c[f].alias(f) for f in CHUNK_FIELDS]))).alias("digest")),
    )
    shaped = notes.filter("note_path is not null and version is not null").select(
        "note_path",
        F.col("version").cast("bigint").alias("version"),
        # a deletion sorts before any text of its version
        F.coalesce(F.md5(F.col("content").cast("binary")), F.lit("")).alias("digest"),
        chunks.alias("chunks"),
    )
    return shaped.groupBy("note_path").transformWithState(_processor(CHUNK_FIELDS), CHANGE, "Update", "None")


def start_refresh(
    notes: DataFrame,
    path: str,
    checkpoint: str,
    *,
    max_chars: int = INDEX_CHUNK_CHARS,
    shape: Callable[[DataFrame], DataFrame] | None = None,
    interval: str | None = FLUSH_INTERVAL,
) -> StreamingQuery:
    """Keep the index log at ``path`` equal to a fresh index of the newest notes.

    ``shape`` turns changes into index rows and keeps ``chunk_id``, ``seq`` and ``deleted``.  The checkpoint
    carries the state, so a restart goes on where the stream stopped and a repeated batch changes nothing.
    """
    spark = notes.sparkSession
    before = spark.conf.get(PROVIDER, None)
    # a stream copies the session's settings when it starts
    spark.conf.set(PROVIDER, ROCKS)
    try:
        changes = changed_chunks(notes, max_chars)
        return start_sink(shape(changes) if shape else changes, path, checkpoint, interval=interval)
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
