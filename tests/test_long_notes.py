"""The text folds take time in proportion to the lines of a note."""

import time

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import markdown as md
from quillmesh.functions import spans as sp
from quillmesh.functions.text import lines_of

C = F.col("c")
FOLDS = {
    "headers": F.size(md.headers(C)),
    "paths": F.size(md.header_paths(md.headers(C))),
    "sections": F.size(md.sections(C)),
    "pack": F.size(md.greedy_pack(C, 500)),
    "chunks": F.size(md.chunks(C, 500)),
    "mask": F.length(md.preprocess(C)),
    "starts": F.size(sp.line_starts(lines_of(C))),
}


def seconds(spark, column, lines, pattern):
    note = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines)), lambda i: F.format_string(pattern, i % 100)), "\n").alias("c"))
    note = spark.createDataFrame([(note.first()[0],)], "c string")
    started = time.perf_counter()
    note.select(column).collect()
    return time.perf_counter() - started


@pytest.mark.parametrize("name", FOLDS)
def test_twice_the_lines_twice_the_time(spark, name):
    # every line a header where headers are what is gathered
    pattern = "# h%02d" if name in ("headers", "paths", "sections", "chunks") else "ab %02d"
    seconds(spark, FOLDS[name], 2_000, pattern)
    once = min(seconds(spark, FOLDS[name], 16_000, pattern) for _ in range(2))
    twice = min(seconds(spark, FOLDS[name], 32_000, pattern) for _ in range(2))
    assert twice <= 2.5 * once + 0.5, (once, twice)


def test_very_long_note(spark):
    assert seconds(spark, FOLDS["chunks"], 200_000, "ab %02d") < 30
    assert seconds(spark, F.size(md.split_long_line(F.replace(C, F.lit("\n"), F.lit(" ")), 500)), 400_000, "ab %02d") < 30
