"""Hard negatives: windows of inner products, found by a vertical scan with bounds.

Vectors are kept in blocks of columns, one array per dimension with its least and greatest
component.  An anchor reads a block's dimensions in the order of its own components, largest
magnitude first.  After a few dimensions every candidate's score lies between its partial sum plus
the least and plus the greatest that the remaining dimensions can add; candidates whose interval
meets no open window leave the bitmap, and the rest read on until their products are exact.

Two passes use the same scan.  The first finds each anchor's positives: the best rows of its own
label, a window that closes from below as better rows are found.  The second has one window per
positive, a share of the positive's score, over the rows of other labels; it also closes from
below once it holds enough rows.

Anchors are a stated query set and meet all rows, block by block.  Up to ``ANCHOR_BYTES`` of them
are broadcast, and blocks are read in place.  More are cut into groups by hash, and groups and
pieces of the table meet in one task per pair.  A task emits only what its windows hold, never a
label's rows.

Rows with a NULL id, label or vector, or with a NULL or non-finite component, take no part.  Shorter
vectors count as padded with zeros.  A row is no positive or negative of anchors that carry its own
id; otherwise repeated rows count as often as they stand there, and a repeated anchor row gives its
results again.  Ties go to the smaller id.  An empty table gives an empty result.  Scores are exact;
they must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.session import discard, materialize

#: Rows of a block, dimensions read between two looks at the bounds.
BLOCK_ROWS = 8192
STEP_DIMS = 8
#: Anchors up to this size are broadcast; larger sets are cut into groups of this size.
ANCHOR_BYTES = 32 << 20
#: Rows of a piece of the table where anchors are grouped.
PIECE_ROWS = 262_144

BLOCKS = "ids array<bigint>, labels array<string>, dims int, data binary"
BLOCK_TYPES = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("dims", pa.int32()), ("data", pa.binary())])
HITS = "anchor bigint, slot int, id bigint, score bigint"
HIT_TYPES = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


class Block:
    """Rows as columns: ``x[d]`` holds component d of every row."""

    def __init__(self, ids, labels, x):
        self.ids, self.labels, self.n = np.asarray(ids, np.int64), np.asarray(labels, object), len(ids)
        top = int(np.abs(x).max()) if x.size else 0
        self.x, self.real, self.top = x, x.astype(np.float64), top
        self.low, self.high = x.min(axis=1), x.max(axis=1)
        self.masks = {}

    def of_label(self, label):
        if label not in self.masks:
            self.masks[label] = self.labels == label
        return self.masks[label]


def _columns(vecs: pa.ListArray) -> np.ndarray:
    """Vectors as rows of components, shorter ones padded with zeros."""
    sizes = vecs.value_lengths().to_numpy(zero_copy_only=False)
    x = np.zeros((len(vecs), sizes.max(initial=0)), np.int64)
    x[np.arange(x.shape[1]) < sizes[:, None]] = vecs.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(x.T)


def to_blocks(rows: DataFrame) -> DataFrame:
    """(id, label, vec) in blocks of columns, formed where the rows lie."""

    def transpose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _columns(part["vec"])
                row = {"ids": part["id"].to_pylist(), "labels": part["label"].to_pylist(), "dims": len(x), "data": x.tobytes()}
                yield pa.RecordBatch.from_pylist([row], BLOCK_TYPES)

    return rows.select("id", "label", "vec").mapInArrow(transpose, BLOCKS)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels, dims, data = (batch[c][i].as_py() for c in ("ids", "labels", "dims", "data"))
            yield Block(ids, labels, np.frombuffer(data, np.int64).reshape(dims, len(ids)))


class Window:
    """The best ``k`` rows found with low <= score <= high; ``low`` rises once there are k."""

    def __init__(self, low, high, k):
        self.low, self.high, self.k = low, high, k
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, object)

    def add(self, ids, scores):
        inside = (scores >= self.low) & (scores <= self.high)
        if inside.any():
            ids, scores = np.r_[self.ids, ids[inside]], np.r_[self.scores, scores[inside].astype(object)]
            best = np.lexsort((ids, -scores.astype(np.float64)))[: self.k] if _exact(scores) else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k])
            self.ids, self.scores = ids[best], scores[best]
            if len(best) == self.k:
                self.low = max(self.low, self.scores[-1])


def _exact(scores) -> bool:
    return max(map(abs, scores), default=0) < 1 << 53


def scan(block: Block, anchor_id: int, vec: np.ndarray, alive: np.ndarray, windows: list[Window]) -> None:
    """Add to each window the block's rows of ``alive`` whose inner product with ``vec`` falls into it."""
    dims = min(len(vec), len(block.x))
    # sums below 2**53 are exact in doubles; others are summed as Python's integers
    small = int(np.abs(vec).max(initial=0)) * block.top * max(dims, 1) < 1 << 53
    kind = np.float64 if small else object
    x = block.real if small else block.x.astype(object)
    vec, low, high = (v[:dims].astype(kind) for v in (vec, block.low, block.high))
    order = np.argsort(-np.abs(vec), kind="stable")
    a, b = vec[order] * low[order], vec[order] * high[order]
    # what the dimensions from each place on can add at least and at most
    least = np.append(np.minimum(a, b)[::-1].cumsum()[::-1], 0)
    most = np.append(np.maximum(a, b)[::-1].cumsum()[::-1], 0)
    rows = np.flatnonzero(alive & (block.ids != anchor_id))
    part = np.zeros(len(rows), x.dtype)
    for at in range(0, dims, STEP_DIMS):
        if not len(rows):
            return
        some = order[at : at + STEP_DIMS]
        part = part + vec[some] @ (x[some] if len(rows) == block.n else x[np.ix_(some, rows)])
        after = min(dims, at + STEP_DIMS)
        bottom, top = part + least[after], part + most[after]
        keep = np.zeros(len(rows), bool)
        for w in windows:
            low_w = w.low
            if after < dims:
                sure = bottom[(bottom >= w.low) & (top <= w.high)]
                if len(sure) > w.k:  # k rows are certain to lie in the window at this score or above
                    low_w = max(low_w, np.partition(sure, len(sure) - w.k)[len(sure) - w.k])
            keep |= (top >= low_w) & (bottom <= w.high)
        if not keep.all():
            rows, part = rows[keep], part[keep]
    for w in windows:
        w.add(block.ids[rows], part if part.dtype == object else part.astype(np.int64))


def _search(blocks: Iterator[Block], anchors: list[dict], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Windows of every anchor over all blocks; ``anchors`` have row, id, label, vec and windows (low, high)."""
    top = 1 << 62
    open_windows = [[Window(-top, top, k)] if same else [Window(lo, hi, k) for lo, hi in a["windows"]] for a in anchors]
    vectors = [np.array(a["vec"], np.int64) for a in anchors]
    for block in blocks:
        for a, vec, windows in zip(anchors, vectors, open_windows, strict=True):
            own = block.of_label(a["label"])
            alive = own if same else ~own
            if alive.any():
                scan(block, a["id"], vec, alive, windows)
    out = [(a["row"], slot, i, s) for a, ws in zip(anchors, open_windows, strict=True) for slot, w in enumerate(ws) for i, s in zip(w.ids.tolist(), w.scores, strict=True)]
    for at in range(0, len(out), 65_536):
        columns = zip(*out[at : at + 65_536], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(map(int, c)), f.type) for c, f in zip(columns, HIT_TYPES, strict=True)], schema=HIT_TYPES)


def _meet(blocks: DataFrame, anchors: DataFrame, same: bool, k: int, anchor_bytes: int, piece_rows: int) -> DataFrame:
    """(anchor, slot, id, score): for each anchor's windows, the best ``k`` rows of every task."""
    spark = blocks.sparkSession
    size = anchors.agg(F.coalesce(F.sum(F.size("vec") * 8 + 64), F.lit(0))).first()[0]
    if size <= anchor_bytes:
        shared = spark.sparkContext.broadcast(anchors.toArrow().to_pylist())

        def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _search(_read_blocks(batches), shared.value, same, k)

        return blocks.mapInArrow(in_place, HITS)

    groups = -(-size // anchor_bytes)
    rows = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    pieces = max(1, -(-rows // piece_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = anchors.withColumn("_group", own("row", groups)).withColumn("_piece", every(pieces))
    # a block that opens with the same ids as another may share its piece, no more
    right = blocks.withColumn("_piece", own("ids", pieces)).withColumn("_group", every(groups))

    def cell(queries: pa.Table, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_search(_read_blocks(table.to_batches()), queries.to_pylist(), same, k)), HIT_TYPES)

    return left.groupBy("_group", "_piece").cogroup(right.groupBy("_group", "_piece")).applyInArrow(cell, HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scaled(vec: Column, scale: int) -> Column:
    """Components times ``scale``, rounded down; NULL where one is NULL or not finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def _floor_percent(score: str, percent: int) -> Column:
    """floor(percent * score / 100) in whole numbers."""
    share = f"cast({percent} as decimal(6, 0)) * cast({score} as decimal(20, 0))"
    return F.expr(f"({share} - pmod({share}, cast(100 as decimal(6, 0)))) div 100")


def mine(
    rows: DataFrame,
    *,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    anchor_bytes: int = ANCHOR_BYTES,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has id, label, vec (whole numbers) and the boolean ``anchor``.  A positive is one of an
    anchor's first ``positives`` rows of its label; its negatives are the first ``negatives`` rows of
    other labels whose score is ``low`` to ``high`` percent of the positive's.
    """
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
    rows = rows.where(usable).select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("string").alias("label"), "vec", "anchor")
    blocks = materialize(to_blocks(rows), "vector-blocks")
    queries = rows.where(F.coalesce("anchor", F.lit(False))).select("id", "label", "vec")
    queries = materialize(queries.withColumn("row", F.monotonically_increasing_id()), "anchors")

    hits = _meet(blocks, queries, True, positives, anchor_bytes, piece_rows)
    best = materialize(_best(hits, positives).select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low * p <= 100 * n <= high * p in whole numbers; p < 0 leaves no room
    ends = F.array(-_floor_percent("-positive_score", low), _floor_percent("positive_score", high))
    windows = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", ends.alias("ends")))).alias("w"))
    windows = windows.select(F.col("anchor").alias("row"), F.col("w.ends").alias("windows"))
    found = _best(_meet(blocks, queries.join(windows, "row"), False, negatives, anchor_bytes, piece_rows), negatives)
    named = best.join(queries.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    result = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score", "rank": "place"}).join(
        named.withColumn("slot", F.col("rank") - 1).drop("rank"), ["anchor", "slot"]
    )
    result = materialize(result.select("anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard-negatives")
    discard(blocks, queries, best)
    return result
