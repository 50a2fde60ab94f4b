"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an Arrow task works on at a time, so that long texts do not pile up as Python objects.
SLICE_ROWS = 512

# The six separators between words, as characters and as a pattern.
SEPARATORS = " \t\n\x0b\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder that holds this package on the path of the session's Python workers.

    Needed where the package is not installed and the driver runs in another folder.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_slices(df: DataFrame, work: Callable[..., Iterator | list], schema: str, setup: Callable | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """Rows through ``work(columns..., [state])`` in Arrow tasks, ``rows`` at a time.

    ``work`` gets one Python list per column of ``df`` and returns one list per
    column of ``schema``.  ``setup()`` runs once in each task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = list(work(*[c.to_pylist() for c in part.columns], *state)) or [()] * len(target)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def fold(c: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
