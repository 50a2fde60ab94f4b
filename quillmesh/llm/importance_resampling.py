"""Resampling towards a target: importance weights from hashed n-grams, exact ranks by regular sampling.

Weights: every n-gram of words falls into one of ``buckets`` hash buckets.  The counts of all
documents and of all target texts give one gain per bucket, an array of fixed size; a document's
weight is the floored mean gain of its n-grams.  Adding seeded Gumbel noise makes the highest scores
a draw without replacement in proportion to the weights.

Ranks: parallel sorting by regular sampling.  Each task sorts its own rows, a run.  Every ``step``-th
row of every run is a regular sample; regular places among the sorted samples are the splitters.
Rows go to the segment between two splitters, counts of the segments give each one's first rank, and
only segments that the draw reaches are exchanged; each merges its pieces of runs in one task.  The
whole sort key ends in the row's place in its run, so that even a row that repeats in a third of the
table is split among segments.

NULL texts have no words.  NULL ids count as the empty text in the noise and come after all others
among equal scores.  Repeated rows are rows of their own.  An empty table gives an empty result; an
empty target gives gains from the documents alone.  Only the id and text are read, so names of other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.common import map_slices
from quillmesh.session import discard, materialize

BUCKETS = 10_000
#: Regular samples that the driver sorts, besides one for each run at most.
SAMPLES = 65_536
#: Rows that a segment should hold, and the most segments there may be.
SEGMENT_ROWS = 65_536
MAX_SEGMENTS = 20_000
#: Buckets of words that a task remembers.
WORD_MEMO = 500_000

# A word in UTF-8: digits, lower-case ASCII letters, and every byte of other characters.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _hasher(n: int, buckets: int) -> Callable[[bytes | None], tuple[np.ndarray, int]]:
    """A function from a text's UTF-8 to the buckets of its n-grams and its number of words."""
    memo: dict[bytes, int] = {}

    def hashed(text: bytes | None) -> tuple[np.ndarray, int]:
        words = _WORD.findall(text.lower()) if text else []  # bytes.lower changes A-Z only
        runs = list(words)
        for k in range(2, n + 1):
            runs += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        if len(memo) > WORD_MEMO:
            memo.clear()
        new = {w for w in runs if w not in memo}
        memo.update((w, zlib.crc32(w) % buckets) for w in new)
        return np.fromiter(map(memo.__getitem__, runs), np.int64, len(runs)), len(words)

    return hashed


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n): n-grams of all texts by bucket.  Each task sums its texts before anything moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = _hasher(n, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(hashed(text.as_py())[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select(F.col(text_col).cast("binary")).mapInArrow(count, "bucket bigint, n bigint")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares in target and documents, per bucket.

    The driver reads two tables of ``buckets`` rows at most.
    """
    s, t = ([0] * buckets for _ in range(2))
    for into, texts in ((s, docs), (t, target)):
        for row in bucket_counts(texts, n, buckets).toLocalIterator():
            into[row.bucket] = row.n
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)], np.int64)


def noise(doc_id, seed: int) -> int:
    """Floored thousandfold Gumbel noise of an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gains: np.ndarray, seed: int, n: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    buckets = len(gains)

    def work(ids, texts, hashed):
        out = []
        for i, text in zip(ids, texts, strict=True):
            found, words = hashed(text)
            weight = int(gains[found].sum()) // len(found) if len(found) else 0
            out.append((i, words, len(found), weight, weight + noise(i, seed)))
        return list(zip(*out, strict=True))

    schema = "id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_slices(source, work, schema, lambda: _hasher(n, buckets))


def _sort_keys(score: pa.Array, ids: pa.Array, seq: pa.Array) -> np.ndarray:
    """Rows as byte strings that compare like (highest score, smallest id, place in the run)."""
    flip = np.uint64(1 << 63)
    as_unsigned = lambda a: a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ flip
    parts = np.empty((len(score), 4), ">u8")
    parts[:, 0] = ~as_unsigned(score)
    parts[:, 1] = ids.is_null().to_numpy(zero_copy_only=False)
    parts[:, 2] = as_unsigned(ids)
    parts[:, 3] = as_unsigned(seq)
    return parts.view("S32").ravel()


def rank_highest(rows: DataFrame, percent: int) -> DataFrame:
    """Add ``rank`` (1, 2, ...) to the highest scores: ``percent`` of the eligible rows, rounded down.

    ``rows`` has bigint columns ``id`` and ``score`` and the boolean ``eligible``; the order is that
    of the score, highest first, then of the id.  All other rows get NULL.
    """
    spark, columns = rows.sparkSession, rows.columns
    order = [F.desc("score"), F.asc_nulls_last("id")]
    # a row's number holds its run and its place among the run's eligible rows
    runs = materialize(rows.sortWithinPartitions(F.desc("eligible"), *order).withColumn("_seq", F.monotonically_increasing_id()), "runs")
    place, run = F.col("_seq").bitwiseAND((1 << 33) - 1), F.shiftright("_seq", 33)
    total = runs.where("eligible").count()
    draw = total * percent // 100
    parts = min(MAX_SEGMENTS, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SEGMENT_ROWS)))
    step = max(1, total // SAMPLES)
    regular = runs.where(F.col("eligible") & (place % step == F.pmod(F.xxhash64(run), F.lit(step))))
    sample = regular.select("score", "id", "_seq").toArrow().combine_chunks()
    keys = np.sort(_sort_keys(*[c.combine_chunks() for c in sample.columns])) if sample.num_rows else np.empty(0, "S32")
    # bytes lose trailing zeros as objects, so splitters travel as an array
    splitters = keys[np.unique(np.arange(1, parts) * len(keys) // parts)] if len(keys) else keys

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.searchsorted(splitters, _sort_keys(b["score"], b["id"], b["_seq"]), side="right")
            segment = pa.array(np.where(b["eligible"].to_numpy(zero_copy_only=False), found, -1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, segment], names=[*b.schema.names, "_segment"])

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in runs.schema.fields)}, _segment int"
    placed = materialize(runs.mapInArrow(split, schema), "segments")
    discard(runs)
    first, sizes = 0, {r["_segment"]: r["count"] for r in placed.where("_segment >= 0").groupBy("_segment").count().collect()}
    starts = []
    for segment in sorted(sizes):
        if first < draw:
            starts.append((segment, first))
        first += sizes[segment]
    reached = F.broadcast(spark.createDataFrame(starts, "_segment int, _first bigint"))
    merged = placed.join(reached, "_segment")
    within = F.row_number().over(W.partitionBy("_segment").orderBy(*order, "_seq"))
    merged = merged.withColumn("rank", F.col("_first") + within)
    merged = merged.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).select(*columns, "rank")
    rest = placed.join(reached, "_segment", "left_anti").select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return merged.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 0, min_words: int = 20, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document.

    ``docs`` has doc_id and text, ``target`` has text.  ``rank`` numbers the drawn ones among the
    documents of at least ``min_words`` words, best first; it is NULL elsewhere.
    """
    gains = bucket_gains(docs, target, n, buckets)
    scored = score(docs, gains, seed, n).withColumn("eligible", F.col("n_words") >= min_words)
    return rank_highest(scored, percent).select("id", "n_features", "weight", "score", "rank")
