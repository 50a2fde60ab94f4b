"""Folders of markdown notes, listed and read by tasks.

``VaultFiles`` is a Spark data source whose partitions are folders: the driver opens folders only until
there are enough of them to share out, tasks list the rest.  ``read_files`` then deals the listed files
evenly over tasks, whatever folder they are in, and each task reads its own.  Files go through Arrow's file
systems (local, hdfs, s3, gs), so empty files are files like others.

Names that begin with a dot are skipped, files and folders alike.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmesh.session import materialize

# Tasks receive the reader by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs")
FILES = "note_path string, length bigint, mtime timestamp"
FILE_TYPES = pa.schema([("note_path", pa.string()), ("length", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))])
LIST_ROWS = 10_000
#: Bytes of files that a task should read, and files that it reads into one batch.
TASK_BYTES = 128 << 20
BATCH_FILES = 256
BATCH_BYTES = 32 << 20


def reachable(root: str) -> bool:
    """Whether tasks can open the folder through Arrow."""
    return (root.split(":", 1)[0] if ":" in root.split("/", 1)[0] else "") in SCHEMES


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if root.startswith("file:") and not root.startswith("file://"):
        root = root[len("file:") :]
    files, path = pafs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
    return files, path.rstrip("/")


def _children(files: pafs.FileSystem, folder: str) -> Iterator[pafs.FileInfo]:
    """What lies in a folder; nothing if it is gone."""
    for found in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if not found.base_name.startswith("."):
            yield found


class Folders(InputPartition):
    """Folders to list: (path, whether with everything below)."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class VaultReader(DataSourceReader):
    def __init__(self, root: str, wanted: int):
        self.root, self.wanted = root, wanted

    def partitions(self) -> list[InputPartition]:
        files, top = open_root(self.root)
        flat, deep = [], [top]
        while deep and len(deep) < self.wanted:
            below = [f.path for folder in deep for f in _children(files, folder) if f.type == pafs.FileType.Directory]
            flat, deep = flat + deep, below
        folders = [(f, False) for f in flat] + [(f, True) for f in deep]
        return [Folders(folders[i :: self.wanted]) for i in range(min(self.wanted, len(folders)))]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        files, top = open_root(self.root)
        rows, open_folders = [], list(partition.folders)
        while open_folders:
            folder, whole = open_folders.pop()
            for f in _children(files, folder):
                if f.type == pafs.FileType.Directory:
                    if whole:
                        open_folders.append((f.path, True))
                elif f.base_name.endswith(".md"):
                    rows.append({"note_path": f.path[len(top) + 1 :], "length": f.size, "mtime": f.mtime})
            if len(rows) >= LIST_ROWS:
                yield pa.RecordBatch.from_pylist(rows, FILE_TYPES)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, FILE_TYPES)


class VaultFiles(DataSource):
    """``spark.read.format("vault_files").load(root)``: path below the root, length and time of every note."""

    @classmethod
    def name(cls) -> str:
        return "vault_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return VaultReader(self.options["path"], int(self.options.get("partitions", "64")))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(note_path, length, mtime) of every note below ``root``, listed by tasks."""
    spark.dataSource.register(VaultFiles)
    wanted = max(64, 4 * spark.sparkContext.defaultParallelism)
    return spark.read.format("vault_files").option("partitions", wanted).load(root)


def read_files(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """Listed files with their ``content`` as bytes; files that went since they were listed are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_root(root)
        schema = pa.schema([*FILE_TYPES, ("content", pa.binary())])
        rows, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with files.open_input_stream(f"{top}/{row['note_path']}") as f:
                        row["content"] = f.read()
                except FileNotFoundError:
                    continue
                rows.append(row)
                size += len(row["content"])
                if len(rows) >= BATCH_FILES or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    total = listed.agg(F.sum("length").alias("bytes")).first().bytes or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return listed.repartition(tasks).mapInArrow(read, f"{FILES}, content binary")


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """(note_path, content as bytes, mtime) of every note below ``root``."""
    return read_files(spark, root, materialize(list_files(spark, root), "listing")).select("note_path", "content", "mtime")


def write_notes(notes: DataFrame, root: str) -> int:
    """Write (note_path, content) as files below ``root``, each task its own rows; the number written.

    A file is replaced whole, so a task that runs again leaves the same files.  Of rows with one path the last
    written stays.  NULL content is an empty file.  Paths that leave the root are refused.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_root(root)
        made = set()
        for batch in batches:
            for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"path outside of the folder: {path}")
                folder = f"{top}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(f"{top}/{path}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = notes.select("note_path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0
