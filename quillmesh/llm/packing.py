"""Best-fit packing of tokenized documents by linear grouping.

Only lengths matter for a plan, and there are at most ``size`` different ones, so the
driver plans from the counts of every length (at most 1,024 numbers whatever the corpus):

1. Large lengths, in falling order, are cut into groups of equal cardinality and
   rounded up to the largest of their group.
2. The few rounded sizes make a cutting-stock problem: column generation finds the
   fractional mix of configurations that needs the fewest sequences, and each
   configuration is used its whole number of times.
3. Actual lengths take the places of the rounded sizes of their group; the last place of a
   sequence and the room that rounding left go to the longest that fit, small ones included.
4. What is left over goes best-fit, longest first.

The plan is a list of runs: so many sequences that hold the same lengths in the same order.
Documents find their place by their rank among the documents of their length;
ranks come from counts per length and bucket of rows, never from one global sort, so
a length that a third of all documents have spreads over many tasks.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import map_slices
from quillmesh.session import materialize

SIZE = 1024
END_ID = 2
#: Lengths up to this part of a sequence are small and fill the room that larger ones leave.
SMALL_PART = 4
GROUPS = 48
#: The fractional mix is at most this share above its optimum.
GAP = 1e-4
#: Rows per rank bucket, about.
BUCKET_ROWS = 100_000

PIECES = "doc_id bigint, row long, piece int, start bigint, length int, ids_crc32 bigint"

# Letters, digits, marks and spaces on which both tokenizer libraries agree (tests go over each of them).
_PLAIN = re.compile(r"[\x00-\x1b\x20-ʯ‐-‧€]*\Z")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of a text, as the JSON tokenizer gives them without special tokens added.

    Its BPE runs at about 1 MB/s.  The same ranks in the other library give the same
    ids six times as fast for plain characters; a text with any other character, or with the
    special token's own string, goes through the JSON tokenizer.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and _PLAIN.match(text) and _SPECIAL not in text:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first one takes the remainder."""
    first = total % size or size
    return [(0, first), *((s, size) for s in range(first, total, size))]


def tokenize_pieces(
    docs: DataFrame, tokenizer: str, ranks: str | None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: (doc_id, row, piece, start, length, ids_crc32).

    A NULL text is an empty one: just the end id.  ``row`` tells apart rows that share an id.
    """

    def work(idents, rows, texts, encoder):
        out = []
        for ident, row, text in zip(idents, rows, texts, strict=True):
            ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
            out += [(ident, row, n, s, k, zlib.crc32(ids[s : s + k].tobytes())) for n, (s, k) in enumerate(cut(len(ids), size))]
        return zip(*out, strict=True)

    rows = docs.select(F.col(id_col).cast("bigint"), F.monotonically_increasing_id(), text_col)
    return map_slices(rows, work, PIECES, lambda: Encoder(tokenizer, ranks))


def group_sizes(counts: dict[int, int], groups: int) -> dict[int, list[tuple[int, int]]]:
    """Rounded size -> the actual (length, count) of its group, longest first."""
    total = sum(counts.values())
    out: dict[int, list[tuple[int, int]]] = {}
    quota, size, room = -(-total // groups), 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        if size and room < left and room < quota // 2:
            size = 0  # a fresh group rather than a length split for a few rows
        if not size or room <= 0:
            size, room = length, quota
        out.setdefault(size, []).append((length, left))
        room -= left
    return out


def _best_column(value: np.ndarray, sizes: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value: an unbounded knapsack over the room of a sequence."""
    best = np.zeros(size + 1)
    pick = np.full(size + 1, -1)
    for room in range(int(sizes.min()), size + 1):
        best[room], pick[room] = best[room - 1], -1
        fits = np.flatnonzero(sizes <= room)
        got = best[room - sizes[fits]] + value[fits]
        k = int(np.argmax(got))
        if got[k] > best[room] + 1e-12:
            best[room], pick[room] = got[k], fits[k]
    column = np.zeros(len(sizes))
    room = size
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            column[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[size]), column


def configurations(demand: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Whole uses of few-size configurations, from the fractional optimum of the cutting-stock problem.

    Column generation on a square basis: each step prices by knapsack, brings in the best
    column and lets the ratio test choose the one that leaves.
    """
    sizes = np.array(sorted(demand, reverse=True))
    need = np.array([demand[s] for s in sizes], float)
    basis = np.diag([float(size // s) for s in sizes])
    for _ in range(20 * len(sizes)):
        inverse = np.linalg.inv(basis)
        level = inverse @ need
        prices = inverse.sum(axis=0)
        value, column = _best_column(prices, sizes, size)
        if value <= 1 + GAP:  # no mix can be better than the present one divided by this value
            break
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, level / np.where(up, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    level = np.linalg.inv(basis) @ need
    out = []
    for j in range(len(sizes)):
        if (uses := int(np.floor(level[j] + 1e-6))) > 0:
            out.append(({int(s): int(n) for s, n in zip(sizes, basis[:, j], strict=True) if n > 0}, uses))
    return out


class _Runs:
    """Runs of sequences alike, found by the room that they have left."""

    def __init__(self, size: int):
        self.size = size
        self.by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        self.rooms: list[int] = []

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        room = self.size - sum(lengths)
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append((lengths, count))

    def best_fit(self, length: int, count: int) -> None:
        """Into the fullest sequences that have the room, else into new ones."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = min(self.size // length, count)
                bins = count // each
                self.add((length,) * each, bins)
                count -= bins * each
                continue
            room = self.rooms[at]
            lengths, bins = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room], self.rooms[at]
            each = min(room // length, count)
            used = min(bins, count // each)
            self.add(lengths + (length,) * each, used)
            if used < bins:
                self.add(lengths, bins - used)
            count -= used * each

    def runs(self) -> list[tuple[tuple[int, ...], int]]:
        return [r for room in self.rooms for r in self.by_room[room]]


def _fill(slots: list[int], lengths: list[int], left: Counter, size: int) -> Counter:
    """Actual lengths in the places of a configuration.

    Every place but the last takes the longest one of its group or below; the last one takes the
    longest that fits, and so do further ones as long as anything fits.
    """
    room, taken = size, Counter()
    for n in range(size):
        most = min(room, slots[n]) if n < len(slots) - 1 else room
        at = bisect_right(lengths, most) - 1
        while at >= 0 and taken[lengths[at]] >= left[lengths[at]]:
            at -= 1
        if at < 0:
            break
        taken[lengths[at]] += 1
        room -= lengths[at]
    return +taken


def plan(counts: dict[int, int], size: int = SIZE, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of a sequence, number of such sequences) that hold every counted length."""
    runs = _Runs(size)
    small_most = size // SMALL_PART
    if counts.get(size):
        runs.add((size,), counts[size])
    large = {k: n for k, n in counts.items() if small_most < k < size and n}
    rest = Counter({k: n for k, n in counts.items() if k <= small_most and n})
    left = Counter(large)
    if large:
        demand = {s: sum(n for _, n in members) for s, members in group_sizes(large, groups).items()}
        left.update(rest)
        lengths = sorted(left)
        for config, uses in sorted(configurations(demand, size), key=lambda c: -max(c[0])):
            slots = [s for s, n in sorted(config.items(), reverse=True) for _ in range(n)]
            while uses and (filled := _fill(slots, lengths, left, size)):
                times = min(uses, *(left[k] // n for k, n in filled.items()))
                runs.add(tuple(sorted(filled.elements(), reverse=True)), times)
                for k, n in filled.items():
                    left[k] -= n * times
                    if not left[k]:
                        del lengths[bisect_left(lengths, k)], left[k]
                uses -= times
        rest = left
    for k in sorted(rest, reverse=True):
        runs.best_fit(k, rest[k])
    return runs.runs()


def _slots(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of each place of each run."""
    used: Counter = Counter()
    out, sequence = [], 0
    for lengths, count in runs:
        offset = 0
        for k in lengths:
            out.append((k, used[k], used[k] + count, sequence, offset))
            used[k] += count
            offset += k
        sequence += count
    return out


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = SIZE, end_id: int = END_ID,
    groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``tokenizer`` is the path of a JSON tokenizer, ``ranks`` that of the same vocabulary as ranks.
    A document of more than ``size`` tokens is cut into pieces of ``size`` of which the first may be
    shorter; no other document is cut.  NULL and empty texts are one end id.  Rows that repeat,
    and rows without id, are packed one by one.  An empty table gives no rows.

    Tokenized pieces (some forty bytes each) are written once to the shared folder, so no text
    is tokenized twice and a lost executor costs its own tasks only.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer, ranks, size, end_id, id_col, text_col), "pieces")
    spark = docs.sparkSession
    buckets = max(1, pieces.count() // BUCKET_ROWS)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(buckets)).cast("int"))
    counted = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    first = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.withColumn("base", F.coalesce(F.sum("n").over(first), F.lit(0)))
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        _slots(plan(totals, size, groups)), "length int, low bigint, high bigint, first_sequence bigint, offset bigint"
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "row", "piece")
    ranked = bucketed.withColumn("place", F.row_number().over(within)).join(bases.drop("n"), ["length", "bucket"])
    placed = ranked.withColumn("rank", F.col("base") + F.col("place") - 1)
    # the plan has some thousand slots whatever the corpus, so every executor gets it
    joined = placed.join(
        F.broadcast(slots),
        (placed["length"] == slots["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    )
    return joined.select(
        "doc_id", "piece", "start", placed["length"].cast("bigint").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset",
    )
