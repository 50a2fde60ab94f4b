"""Reading notes from files or tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import basename
from quillmesh.sources import vault

#: Empty files that are listed in one piece.
LIST_ROWS = 100_000


def title_of(path):
    """File name without its extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*\z", "")


def list_empty(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified_ms) of every empty markdown file under ``root``.

    Spark's file sources skip empty files, so the names come from the file system's own
    listing, which the driver reads as a stream: a name and a time per file, in pieces of ``LIST_ROWS``.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    parts, rows = [], []
    schema = "path string, modified_ms bigint"
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0 and f.getPath().getName().endswith(".md"):
            rows.append((f.getPath().toString(), f.getModificationTime()))
            if len(rows) == LIST_ROWS:
                parts.append(spark.createDataFrame(rows, schema))
                rows = []
    parts.append(spark.createDataFrame(rows, schema))
    return functools.reduce(DataFrame.unionByName, parts)


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """Every markdown file under ``root``: (note_path, title, content, mtime); empty notes have empty content.

    ``note_path`` is relative to the root.  Folders are listed and files read by tasks (see ``vault``), where
    Arrow knows the file system; elsewhere by Spark's file source, which skips names that begin with ``_``, and
    the driver's listing of empty files.
    """
    found = vault.read_notes(spark, root) if vault.reachable(root) else _by_file_source(spark, root)
    text = F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    return found.select("note_path", title_of(F.col("note_path")).alias("title"), text, "mtime")


def _by_file_source(spark: SparkSession, root: str) -> DataFrame:
    full = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.md")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .load(root)
        .select("path", "content", F.col("modificationTime").alias("mtime"))
    )
    empty = list_empty(spark, root).select("path", F.lit(b"").alias("content"), F.timestamp_millis("modified_ms").alias("mtime"))
    base = root.rstrip("/").split("://")[-1]
    if base.startswith("file:"):
        base = base[len("file:") :]
    path = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    relative = F.substring(path, F.lit(len(base) + 2), F.length(path))
    return full.unionByName(empty).select(relative.alias("note_path"), "content", "mtime")


def scan_notes(table: DataFrame) -> DataFrame:
    """Markdown notes of a table with at least (note_path, content)."""
    return table.filter(F.endswith("note_path", F.lit(".md"))).select(
        "note_path", title_of(F.col("note_path")).alias("title"), "content"
    )
