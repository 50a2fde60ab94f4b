"""Benchmark passages in training texts, found with spaced seeds.

A seed is a fixed mask of token positions; the positions between them are ignored, so
a seed still hits where a passage had a word replaced.  The words under every mask
are hashed on both sides and the hashes are joined; around each hit the two rows of words are laid side
by side and the overlap is verified, replaced words included.

Both sides stay tables.  The distinct texts of the benchmark become seed rows in Spark, and a filter of at most
``MAX_FILTER_BITS`` bits, whatever the size of the benchmark, tells the tasks which positions of a text
may have a partner; only texts with such a position leave their task, once for each distinct text.  Seeds, items and texts are
then joined by shuffles whose frequent keys are salted.  A crowded filter lets more positions through and changes
no result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_slices
from quillmesh.session import discard, materialize

#: Token positions that a seed compares, from its first token on.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 6, 7), (0, 1, 3, 4, 7, 8), (0, 2, 3, 5, 8, 9))
#: An overlap counts if it has so many equal words, or ``MIN_COVER`` of the item's words if that is more ...
MIN_EQUAL = 10
MIN_COVER = 0.5
#: ... or so many equal words whatever the item's length ...
LONG_EQUAL = 25
#: ... and at least this share of its words is equal.
MIN_IDENTITY = 0.75
#: Items of fewer than ``MIN_EQUAL`` words occur as a whole; from so many words on, one of them may be replaced.
MIN_TOLERANT = 6
#: Seeds of items of six or seven, and of eight or nine words: every other word, so that one replaced word spares a seed.
SHORT_MASKS = ((0, 2, 4), (0, 2, 4, 6))
#: Seeds of still shorter items: all of their words.
WHOLE_MASKS = tuple(tuple(range(n)) for n in range(1, MIN_TOLERANT))
ALL_MASKS = (*MASKS, *SHORT_MASKS, *WHOLE_MASKS)

#: Bits of the filter for each seed, and at most (32 MB).
FILTER_BITS = 256
MAX_FILTER_BITS = 1 << 28
PROBES = 4
#: Rows of one key in a join from which it is salted, and the most keys that are.
HOT_ROWS = 20_000
MAX_HOT_KEYS = 4_096
#: Hashes of words that a task remembers, and words that it looks at together.
KNOWN_WORDS = 1 << 20
RUN_WORDS = 1 << 17

FOUND = "id bigint, n_items bigint, n_words bigint, items string, spans string, contaminated boolean"
_WORDS = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class WordHashes(dict):
    """The 64-bit hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def row(self, text: str | None) -> np.ndarray:
        words = tokens(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seed_hashes(words: np.ndarray, mask: int) -> np.ndarray:
    """The hash of the words under a mask (by its number) at every position where it fits."""
    offsets = ALL_MASKS[mask]
    n = max(0, len(words) - offsets[-1])
    key = np.full(n, mask + 1, np.uint64)
    for k in offsets:
        key = (key ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key


def item_seeds(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask, hashes, positions) of the seeds that stand for an item."""
    n = len(words)
    if n >= MIN_EQUAL:
        for mask in range(len(MASKS)):
            key = seed_hashes(words, mask)
            yield mask, key, np.arange(len(key))
    elif n >= MIN_TOLERANT:
        mask = len(MASKS) + (n >= 8)
        yield mask, seed_hashes(words, mask)[:2], np.arange(2)
    elif n:
        mask = ALL_MASKS.index(tuple(range(n)), len(MASKS) + len(SHORT_MASKS))
        yield mask, seed_hashes(words, mask), np.arange(1)


def best_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the best run of a row of matches; a replaced word costs three matches.

    With that cost every run kept has three equal words for each replaced one, which is ``MIN_IDENTITY``.
    """
    gain = np.where(equal, 1, -3)
    total = np.concatenate(([0], np.cumsum(gain)))
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    start = int(np.argmax(total[: end + 1] == lowest[end]))
    return start, end, int(equal[start:end].sum())


def overlaps(equal: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of a row of matches that count for an item of ``size`` words, in order."""
    if size < MIN_EQUAL:
        at = np.flatnonzero(equal)
        enough = len(at) >= size - (size >= MIN_TOLERANT)
        return [(int(at[0]), int(at[-1]) + 1)] if enough and len(at) else []
    least = min(LONG_EQUAL, max(MIN_EQUAL, MIN_COVER * size))
    found, open_ = [], [(0, len(equal))]
    while open_:
        low, high = open_.pop()
        if high - low < least:
            continue
        start, end, n = best_overlap(equal[low:high])
        if n >= least:
            found.append((low + start, low + end))
            open_ += [(low, low + start), (low + end, high)]
    return sorted(found)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct values of ``x - y``; many pairs are counted by one convolution instead."""
    if len(a) * len(b) <= 1 << 16:
        return np.unique(np.subtract.outer(a, b))
    low, high = int(a[0]), int(b[-1])  # both are in order
    one, two = np.zeros(int(a[-1]) - low + 1), np.zeros(high - int(b[0]) + 1)
    one[a - low], two[high - b] = 1, 1
    n = 1 << (len(one) + len(two) - 1).bit_length()
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(one, n) * np.fft.rfft(two, n), n) > 0.5) + low - high


def _signed(keys: np.ndarray) -> list[int]:
    return keys.view(np.int64).tolist()


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct word rows of the benchmark: (item, words, ids, n)."""

    def work(idents, texts, hashes):
        rows = [hashes.row(t) for t in texts]
        # an item is known by two digests of its words
        names = [f"{xxhash.xxh3_128_hexdigest(r.tobytes())}{len(r)}" for r in rows]
        return names, [_signed(r) for r in rows], idents

    rows = benchmark.select(F.col(id_col).cast("bigint"), F.col(text_col))
    words = map_slices(rows, work, "item string, words array<bigint>, id bigint", WordHashes).where(F.size("words") > 0)
    return words.groupBy("item").agg(
        F.first("words").alias("words"), F.array_sort(F.collect_set("id")).alias("ids"), F.count("*").alias("n")
    )


def _seeds(items: DataFrame) -> DataFrame:
    """One row for each seed hash of an item: (key, mask, item, ats)."""

    def work(names, rows):
        out = []
        for name, row in zip(names, rows, strict=True):
            for mask, keys, at in item_seeds(np.array(row, np.int64).view(np.uint64)):
                for key, where in _by_key(keys, at):
                    out.append((key, mask, name, where))
        return zip(*out, strict=True)

    return map_slices(items.select("item", "words"), work, "key bigint, mask int, item string, ats array<int>", rows=64)


def _by_key(keys: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """(hash, its positions in order)."""
    grouped = defaultdict(list)
    for key, where in zip(_signed(keys), at.tolist(), strict=True):
        grouped[key].append(where)
    yield from grouped.items()


def _filter(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(bits of the seeds' hashes, masks in use); at most ``MAX_FILTER_BITS`` bits and all masks."""
    counts = seeds.groupBy("mask").count().collect()
    size = max(1 << 16, 1 << (FILTER_BITS * sum(r["count"] for r in counts) - 1).bit_length())
    size = min(size, MAX_FILTER_BITS)
    step = F.shiftrightunsigned("key", 32).bitwiseOR(F.lit(1).cast("bigint"))
    low = F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    places = F.array(*[(low + step * k).bitwiseAND(F.lit(size - 1).cast("bigint")) for k in range(PROBES)])
    at = seeds.select(F.explode(places).alias("at"))
    cell = F.shiftright("at", 6).alias("cell")
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")
    found = at.select(cell, bit).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size >> 6, np.int64)
    bits[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint64), sorted(r["mask"] for r in counts)


def _passing(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter knows."""
    at = np.arange(len(keys))
    size = np.uint64((len(bits) << 6) - 1)
    for k in range(PROBES):
        mine = keys[at]
        place = ((mine & np.uint64(0xFFFFFFFF)) + ((mine >> np.uint64(32)) | np.uint64(1)) * np.uint64(k)) & size
        at = at[(bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _runs(rows: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``RUN_WORDS`` words; a longer text is a run by itself."""
    low = n = 0
    for high, row in enumerate(rows):
        if n and n + len(row) > RUN_WORDS:
            yield low, high
            low, n = high, 0
        n += len(row)
    if n:
        yield low, len(rows)


def _hits(rows: list[np.ndarray], masks: list[int], bits: np.ndarray) -> dict[int, list[dict]]:
    """The hashes that the filter knows, and their positions, for each text that has any; the texts are looked at in one row."""
    words = np.concatenate(rows)
    ends = np.cumsum([len(r) for r in rows])
    hits = defaultdict(list)
    for mask in masks:
        keys = seed_hashes(words, mask)
        at = _passing(keys, bits)
        text = np.searchsorted(ends, at, "right")
        inside = at + ALL_MASKS[mask][-1] < ends[text]  # the words of a seed are those of one text
        at, text = at[inside], text[inside]
        for n in np.unique(text).tolist():
            mine = at[text == n]
            hits[n] += [{"key": key, "at": where} for key, where in _by_key(keys[mine], mine - (ends[n] - len(rows[n])))]
    return hits


def _digest(text_col: str):
    return F.md5(F.col(text_col).cast("binary"))


def _candidates(docs: DataFrame, text_col: str, bits: np.ndarray, masks: list[int]) -> DataFrame:
    """Distinct texts with a position that the filter lets through: (digest, words, hits)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def work(digests, texts, hashes):
        out = []
        rows = [hashes.row(t) for t in texts]
        for low, high in _runs(rows):
            found = _hits(rows[low:high], masks, shared.value)
            out += [(digests[low + n], _signed(rows[low + n]), hits) for n, hits in found.items()]
        return zip(*out, strict=True)

    rows = docs.where(F.col(text_col).isNotNull()).select(_digest(text_col), F.col(text_col))
    found = map_slices(rows, work, "digest string, words array<bigint>, hits array<struct<key:bigint,at:array<int>>>", WordHashes)
    return found.groupBy("digest").agg(F.first("words").alias("words"), F.first("hits").alias("hits"))


def _spread_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join of a stored table with one that has few rows for each key; frequent keys of ``left`` are salted.

    At most ``MAX_HOT_KEYS`` keys are, because a key counts as frequent only with more than that share of the rows.
    """
    limit = max(HOT_ROWS, left.count() // MAX_HOT_KEYS)
    counted = left.groupBy(on).count().where(F.col("count") > limit)
    hot = [(r[0], -(-r[1] // limit)) for r in counted.collect()]
    if not hot:
        return left.join(right, on)
    kind = dict(left.dtypes)[on]
    spread = F.broadcast(left.sparkSession.createDataFrame(hot, f"{on} {kind}, _copies bigint"))
    copies = F.coalesce("_copies", F.lit(1))
    salt = F.pmod(F.xxhash64(*[c for c in left.columns if c != on]), copies)
    salted = left.join(spread, on, "left").withColumn("_salt", salt).drop("_copies")
    each = right.join(spread, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))).drop("_copies")
    return salted.join(each, [on, "_salt"]).drop("_salt")


def _diagonals(names, digests, ats, wheres):
    out = []
    for item, digest, at, where in zip(names, digests, ats, wheres, strict=True):
        out += [(item, digest, s) for s in differences(np.array(where), np.array(at)).tolist()]
    return zip(*out, strict=True)


def _verify(digests, names, firsts, sizes, ours, theirs):
    out = []
    for digest, item, first, size, a, b in zip(digests, names, firsts, sizes, ours, theirs, strict=True):
        out += [(digest, item, first + s, first + e) for s, e in overlaps(np.array(a) == np.array(b), size)]
    return zip(*out, strict=True)


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    """One stored row for each distinct text with a benchmark item: (digest, n_items, items, spans)."""
    items = materialize(_items(benchmark, item_id_col, item_text_col), "benchmark_items")
    seeds = materialize(_seeds(items), "benchmark_seeds")
    texts = materialize(_candidates(docs, text_col, *_filter(seeds)), "candidate_texts")
    hits = materialize(texts.select("digest", F.explode("hits").alias("h")).select(F.col("h.key").alias("key"), "digest", F.col("h.at").alias("at")), "seed_hits")
    met = _spread_join(hits, seeds.select("key", "item", "ats"), "key").select("item", "digest", "ats", "at")
    pairs = materialize(map_slices(met, _diagonals, "item string, digest string, shift int").distinct(), "diagonals")
    # each diagonal takes only the words that lie beside each other
    row = F.col("words")
    beside = _spread_join(pairs, items.select("item", row.alias("row")), "item").select("digest", "item", "shift", "row")
    beside = materialize(beside.select(
        "digest", "item", F.greatest(F.col("shift"), F.lit(0)).alias("first"), F.size("row").alias("size"),
        F.expr("slice(row, 1 + greatest(-shift, 0), greatest(size(row) - greatest(-shift, 0), 0))").alias("row"),
    ), "laid_beside")
    laid = _spread_join(beside, texts.select("digest", "words"), "digest")
    laid = laid.withColumn("mine", F.expr("slice(words, first + 1, size(row))")).withColumn("row", F.expr("slice(row, 1, size(mine))"))
    spans = materialize(map_slices(laid.select("digest", "item", "first", "size", "row", "mine"), _verify, "digest string, item string, a int, b int"), "overlaps")
    of_items = materialize(spans.select("digest", "item").distinct(), "found_items")
    named = _spread_join(of_items, items.select("item", "ids", "n"), "item")
    by_item = named.groupBy("digest").agg(
        F.sum("n").alias("n_items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items")
    )
    by_span = spans.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    found = materialize(by_item.join(by_span, "digest"), "contaminated_texts")
    discard(items, seeds, texts, hits, pairs, beside, spans, of_items)
    return found


#: Distinct texts found that are broadcast; more are joined by a salted shuffle.
BROADCAST_TEXTS = 100_000
SALTS = 32


def _by_text(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` with ``_digest``, joined with rows by digest; copies of one text may be a third of ``docs``."""
    if found.count() <= BROADCAST_TEXTS:
        return docs.join(F.broadcast(found), "_digest", how)
    salted = docs.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    each = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(each, ["_digest", "_salt"], how).drop("_salt")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document row: (id, n_items, n_words, items, spans, contaminated).

    ``items`` are the ids of the benchmark items found, in order; ``spans`` are the word
    ranges of all their overlaps.  Items shorter than ``MIN_EQUAL`` words count only if they occur as a
    whole, one word replaced in those of ``MIN_TOLERANT`` words or more.  NULL and wordless items and texts match nothing, an empty benchmark leaves all
    documents clean, and repeated rows are judged alike.  An item given twice counts
    twice in ``n_items`` and once in ``items``; ids that are NULL count and are not listed.
    """
    found = _found(docs, benchmark, text_col, item_id_col, item_text_col).select(
        F.col("digest").alias("_digest"), "n_items", F.array_join("items", ",").alias("items"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["a"].cast("string"), s["b"].cast("string"))), ",").alias("spans"),
        F.expr(
            "aggregate(spans, named_struct('n', 0L, 'e', 0), (t, s) -> named_struct("
            "'n', t.n + greatest(s.b - greatest(s.a, t.e), 0), 'e', greatest(t.e, s.b))).n"
        ).alias("n_words"),
    )
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), _digest(text_col).alias("_digest"))
    none = F.lit(0).cast("bigint")
    return _by_text(rows, found, "left").select(
        "id", F.coalesce("n_items", none).alias("n_items"), F.coalesce("n_words", none).alias("n_words"),
        F.coalesce("items", F.lit("")).alias("items"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.col("n_items").isNotNull().alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The input's rows in which no benchmark item is found; all columns stay, whatever their names."""
    found = _found(docs, benchmark, text_col, item_id_col, item_text_col).select(F.col("digest").alias("_digest"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _digest(text_col).alias("_digest"))
    return _by_text(held, found, "left_anti").select("_row.*")
