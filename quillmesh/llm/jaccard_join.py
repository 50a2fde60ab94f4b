"""Near-duplicate documents: an exact Jaccard join over word shingles with a token-group matrix.

1. Documents with equal shingle sets are one class from the start.
2. The tokens (64-bit hashes of shingles) have one global order: rare ones by hash, then frequent ones by hash.
   Two sets of similarity ``t`` share a token among the first ``n - ceil(t n) + 1`` of each,
   so only these are listed by token.  Frequent tokens - shared passages - come last, so they are
   listed only where little else is left.
3. Within a token's list every class is paired with the list's first class and with the one before it;
   of the pairs met often enough, those of a class and the ``PARTNERS`` before it that it meets most are compared.  That is
   linear in the classes, and gathers similar documents in groups: the components so far.
4. Lists whose classes are all in one group are done: nothing can come of them.  For the others the
   token-group matrix holds the union of listed tokens of every group.  The tokens that a class shares with a
   group bound its overlap with any member; only groups that can reach the similarity are opened: first
   for ``PROBES`` members each of the ``PARTNERS`` groups that a class shares most with, which merges what belongs together,
   then for all members of all groups left,
   in blocks that the union of their own tokens opens or keeps shut.  One link to a member is enough there, because
   a group is one component already.

No link that could join two groups is lost, a group of near copies costs rows in proportion to its members, and nothing but
the ``HEAVY_TOKENS`` most frequent tokens goes through the driver.  Comparisons read the
two texts, which is less to move than two sets of hashes.  Classes and shingles are known by
64-bit hashes; two of a billion classes share one with a chance of 3 percent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import map_slices
from quillmesh.llm.components import components
from quillmesh.session import discard, discard_unheld, materialize

SHINGLE = 5
#: The similarity of a link, as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: Frequent tokens that are put last in the order at most, and the least number of classes that makes a token frequent.
HEAVY_TOKENS = 1 << 18
HEAVY_LEAST = 16
#: Tokens that a task counts together.
COUNT_TOKENS = 4_000_000
#: Shared tokens that the matrix may miss before it counts one whose place in either set comes too late.
LATE = 2
#: Earlier classes that a class is compared with before there are groups, and groups that it is compared with before all are;
#: what the others could add is found after that.
PARTNERS = 8
#: Members of a group that a class is compared with before the group is opened as a whole.
PROBES = 8
#: Texts of a block of a group, about.
BLOCK = 32
#: Classes up to this many (8 bytes each) are broadcast to choose the texts of pairs.
FEW_KEYS = 200_000
#: Sets that a task remembers while it compares pairs.
REMEMBERED = 2_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingles:
    """Texts to sorted sets of shingle hashes; remembers the hashes of up to a million words."""

    def __init__(self):
        self.known = _Hashes()
        self.sets: dict[int, np.ndarray] = {}

    def of(self, key: int, text: str) -> np.ndarray:
        """The set of a class, remembered."""
        if key not in self.sets:
            if len(self.sets) >= REMEMBERED:
                self.sets.clear()
            self.sets[key] = self(text)
        return self.sets[key]

    def __call__(self, text: str | None) -> np.ndarray:
        """Words lower-cased in A-Z; a text of fewer words than a shingle is one shingle."""
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(SHINGLE, len(words))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = (out ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def class_of(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes()))))


def prefix_length(n: int) -> int:
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: (id, row key, class, size) of each row; kind 1: (token, classes) of tokens met twice in a task."""
    shingles, seen = Shingles(), set()
    waiting, tokens = [], 0

    def counted():
        t, n = np.unique(np.concatenate(waiting), return_counts=True)
        t, n = t[n > 1].view(np.int64), n[n > 1]
        empty = pa.nulls(len(t), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(t), np.int32)), empty, empty, pa.array(t), pa.array(n.astype(np.int64))], names=["kind", "id", "rk", "key", "n"]
        )

    for b in batches:
        keys, sizes = [], []
        for text in b["text"].to_pylist():
            s = shingles(text)
            key = class_of(s) if len(s) else None
            keys.append(key)
            sizes.append(len(s))
            if key is not None and key not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                waiting.append(s)
                tokens += len(s)
                if tokens > COUNT_TOKENS:
                    yield counted()
                    waiting, tokens = [], 0
        kind = pa.array(np.zeros(b.num_rows, np.int32))
        yield pa.RecordBatch.from_arrays(
            [kind, b["id"], b["rk"], pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], names=["kind", "id", "rk", "key", "n"]
        )
    if waiting:
        yield counted()


def _heavy(facts: DataFrame) -> np.ndarray:
    """The most frequent tokens, at most ``HEAVY_TOKENS``, chosen by a histogram of their counts."""
    counts = facts.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_LEAST)
    width = (4 * F.log2("n")).cast("int")
    bars = counts.groupBy(width.alias("bar")).agg(F.count("*").alias("n")).orderBy(F.desc("bar")).collect()
    total, least = 0, None
    for r in bars:
        total += r["n"]
        if total > HEAVY_TOKENS:
            break
        least = r["bar"]
    if least is None:
        return np.empty(0, np.uint64)
    rows = counts.where(width >= least).select("key").collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def _list_tokens(heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(), set()
        for b in batches:
            tokens, keys, sizes, rests = [], [], [], []
            for text in b["text"].to_pylist():
                s = shingles(text)
                if not len(s) or (key := class_of(s)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                take = prefix_length(len(s))
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    common = heavy[at] == s
                    first = np.concatenate([s[~common], s[common]])[:take]
                else:
                    first = s[:take]
                tokens.append(first.view(np.int64))
                keys.append(np.full(take, key, np.int64))
                sizes.append(np.full(take, len(s), np.int32))
                rests.append(np.arange(len(s), len(s) - take, -1, dtype=np.int32))
            if tokens:
                columns = [pa.array(np.concatenate(c)) for c in (tokens, keys, sizes, rests)]
                table = pa.RecordBatch.from_arrays(columns, names=["token", "key", "n", "rest"])
                for start in range(0, table.num_rows, 200_000):
                    yield table.slice(start, 200_000)

    return run


def _size_fits(a, b):
    low, high = F.least(a, b), F.greatest(a, b)
    return DENOMINATOR * low >= NUMERATOR * high


def _least_shared(n, m):
    """Listed tokens that similar sets of sizes ``n`` and ``m`` share at least.

    Their overlap is at least ``t (n + m) / (1 + t)``.  Of the set whose listed tokens end first in the order, all overlap up
    to there is listed in both, and what comes after is at most its unlisted rest, ``ceil(t n) - 1``.
    """
    overlap = F.floor(NUMERATOR * (n + m) / F.lit(NUMERATOR + DENOMINATOR))
    rest = F.ceil(NUMERATOR * F.greatest(n, m) / F.lit(DENOMINATOR))
    return F.greatest(F.lit(1), overlap - rest)


def _early(rest, sizes):
    """Whether a shared token with ``rest`` tokens from it on can be among the first ``LATE + 1`` of similar sets of those sizes in all."""
    return (NUMERATOR + DENOMINATOR) * (rest + LATE) >= NUMERATOR * sizes


def _texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, text) of each class once, by the chosen rows (key, rk, copies).

    Few of them choose the texts in place.  Repeated rows are equal in rk; only their texts move, so that one stays.
    """
    if chosen.count() > FEW_KEYS:
        # the join brings equal rows together
        return rows.join(chosen, "rk").dropDuplicates(["rk", "key"]).select("key", "text")
    texts = rows.join(F.broadcast(chosen.where("copies = 1")), "rk").select("key", "text")
    repeated = chosen.where("copies > 1")
    if repeated.isEmpty():
        return texts
    return texts.unionByName(rows.join(F.broadcast(repeated), "rk").dropDuplicates(["rk", "key"]).select("key", "text"))


def _named(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts of the classes named; if these are many, all texts."""
    named = keys.distinct()
    return texts.join(F.broadcast(named), "key", "left_semi") if named.limit(FEW_KEYS + 1).count() <= FEW_KEYS else texts


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar."""

    def work(a, b, x, y, shingles):
        keep = [similar(shingles.of(i, s), shingles.of(j, t)) for i, j, s, t in zip(a, b, x, y, strict=True)]
        return [v for v, k in zip(a, keep, strict=True) if k], [v for v, k in zip(b, keep, strict=True) if k]

    texts = _named(texts, pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))))
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return map_slices(both, work, "a bigint, b bigint", Shingles)


def _ask(lists: DataFrame, grouped: DataFrame) -> DataFrame:
    """(a, group, members, only, shared): the classes and the other groups that can hold a similar set, and the tokens that tell so.

    Of two groups the classes of the smaller one ask, which covers every pair between them.

    ``rest`` is the number of a class's tokens from a listed one on.  The first token that two similar sets share stands
    so early that the smaller ``rest`` is no less than their overlap; the next may stand one place later, and so
    on.  Only tokens that early are counted, with ``LATE`` places to spare, so the first ``LATE + 1`` shared tokens of
    a similar pair count.  Tokens of a common passage that ends many sets stand too late.
    """
    members = grouped.groupBy("component").agg(F.count("*").alias("members")).withColumnRenamed("component", "group")
    placed = lists.select("token", "key", "n", "rest").join(grouped.withColumnRenamed("node", "key"), "key", "left")
    placed = placed.select("token", "key", "n", "rest", F.coalesce("component", "key").alias("group"))
    mixed = placed.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("token")
    matrix = placed.join(mixed, "token").join(members, "group", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    matrix = materialize(matrix, "matrix")
    cells = matrix.groupBy("token", "group").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.first("members").alias("members"), F.min("key").alias("only"),
        F.max("rest").alias("reach"),
    )
    query = matrix.select("token", F.col("key").alias("a"), "n", "rest", F.struct("members", "group").alias("own"))
    smaller = F.col("own") < F.struct("members", "group")
    can = (DENOMINATOR * F.col("n") >= NUMERATOR * F.col("low")) & (DENOMINATOR * F.col("high") >= NUMERATOR * F.col("n"))
    # the overlap of similar sets is least with the smallest partner that the group can have
    partner = F.greatest("low", F.ceil(NUMERATOR * F.col("n") / F.lit(DENOMINATOR)))
    met = query.join(cells, "token").where(smaller & can & _early(F.least("rest", "reach"), F.col("n") + partner))
    asked = met.groupBy("a", "group").agg(
        F.count("*").alias("shared"), F.first("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.first("members").alias("members"), F.min("only").alias("only"),
    )
    # the bound falls towards both ends of the sizes that a partner can have
    low = F.greatest("low", F.floor(NUMERATOR * F.col("n") / F.lit(DENOMINATOR)))
    high = F.least("high", F.ceil(DENOMINATOR * F.col("n") / F.lit(NUMERATOR)))
    bound = F.least(_least_shared(F.col("n"), low), _least_shared(F.col("n"), high), F.lit(LATE + 1))
    asked = materialize(asked.where(F.col("shared") >= bound).select("a", "group", "members", "only", "shared"), "asked")
    discard(matrix)
    return asked


def _probes(asked: DataFrame, grouped: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (a, b) of the classes asked and about ``PROBES`` members of their groups, or of the ``most`` groups that each shares most with, without those done."""
    if most is not None:
        best = Window.partitionBy("a").orderBy(F.desc("shared"), "group")
        asked = asked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    single = asked.where("members = 1").select("a", F.col("only").alias("b"))
    member = grouped.select(F.col("node").alias("b"), F.col("component").alias("group"))
    sizes = asked.where("members > 1").select("group", "members").distinct()
    share = F.pmod(F.xxhash64("b", "group"), F.greatest(F.lit(1), F.floor(F.col("members") / PROBES)))
    chosen = member.join(sizes, "group").where(share == 0).select("b", "group")
    wide = asked.where("members > 1").select("a", "group").join(chosen, "group").select("a", "b")
    pairs = single.unionByName(wide).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")


def _open(asked: DataFrame, grouped: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of the classes asked and members of their groups, at most one of a class and a group.

    A group is one component, so further links to it would join nothing; a class with any link to it has one here.

    Both sides are cut into blocks of about ``BLOCK`` texts, and a row is a block of classes that ask beside a block of
    members.  The union of a block's tokens bounds what a class can share with its members; only
    where it is enough is the class compared with them.
    """
    wide = asked.select("a", "group")
    members = grouped.select(F.col("node").alias("b"), F.col("component").alias("group")).join(wide.select("group").distinct(), "group")
    texts = _named(texts, wide.select(F.col("a").alias("key")).unionByName(members.select(F.col("b").alias("key"))))

    def blocks(rows: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
        sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
        placed = rows.join(sizes, "group").withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")))
        full = placed.join(texts.withColumnRenamed("key", key), key).groupBy("group", "_block")
        return full.agg(F.collect_list(key).alias(names[0]), F.collect_list("text").alias(names[1])).drop("_block")

    def work(group, a, x, b, y, shingles):
        left, right, into = [], [], []
        for own, keys, texts_, others, theirs in zip(group, a, x, b, y, strict=True):
            sets = [shingles.of(k, t) for k, t in zip(others, theirs, strict=True)]
            union = np.unique(np.concatenate(sets))
            for key, text in zip(keys, texts_, strict=True):
                mine = shingles.of(key, text)
                at = np.minimum(np.searchsorted(union, mine), len(union) - 1)
                if DENOMINATOR * np.count_nonzero(union[at] == mine) < NUMERATOR * len(mine):
                    continue
                found = next((o for o, s in zip(others, sets, strict=True) if similar(mine, s)), None)
                if found is not None:
                    left.append(key)
                    right.append(found)
                    into.append(own)
        return left, right, into

    both = blocks(wide, "a", ("a", "x")).join(blocks(members, "b", ("b", "y")), "group").select("group", "a", "x", "b", "y")
    found = map_slices(both, work, "a bigint, b bigint, group bigint", Shingles, rows=4).groupBy("a", "group").agg(F.min("b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: (id, rk, n_shingles, component_id, first).

    ``component_id`` is the smallest id that links reach, the row's own included.  NULL, empty and wordless
    texts have no shingles and are linked with nothing: their component is their own id.  Rows without id take part;
    a component of such rows only has component NULL.  ``rk`` is a hash of id and text, and ``first`` marks
    the rows of smallest (id, rk) in their component; repeated rows are equal in both and all marked.
    An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("rk"), "text")
    facts = materialize(rows.mapInArrow(_facts, "kind int, id bigint, rk bigint, key bigint, n bigint"), "facts")
    listed = rows.select("text").mapInArrow(_list_tokens(_heavy(facts)), "token bigint, key bigint, n int, rest int")

    # lists of two classes or more, with the list's first class and the one before each
    order = Window.partitionBy("token").orderBy("n", "key")
    whole = Window.partitionBy("token")
    once = listed.withColumn("before", F.lag("key").over(order)).where("before is null or before <> key").drop("before")
    ranked = once.select(
        "*",
        F.count("*").over(whole).alias("size"),
        F.first("key").over(order).alias("lead"),
        F.first("n").over(order).alias("lead_n"),
        F.first("rest").over(order).alias("lead_rest"),
        F.lag("key").over(order).alias("prev"),
        F.lag("n").over(order).alias("prev_n"),
        F.lag("rest").over(order).alias("prev_rest"),
    )
    lists = materialize(ranked.where("size > 1"), "lists")
    near = [
        lists.where(F.col("key") != F.col(k)).select(
            "key", F.col(k).alias("other"), F.col("n").cast("bigint").alias("n"), F.col(f"{k}_n").cast("bigint").alias("m"), F.least("rest", f"{k}_rest").alias("rest")
        )
        for k in ("lead", "prev")
    ]
    # tokens that stand too late for a similar pair's first ones are not worth moving; what that misses the matrix finds
    met = near[0].unionByName(near[1]).where(_size_fits("n", "m") & _early(F.col("rest"), F.col("n") + F.col("m"))).repartition("key").groupBy("key", "other")
    met = met.agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    # a pair that another list's first class hides, or that a class's better partners do, is found by the matrix
    often = met.where(2 * F.col("shared") >= F.least(_least_shared(F.col("n"), F.col("m")), F.lit(2 * LATE)))
    best = Window.partitionBy("key").orderBy(F.desc("shared"), "other")
    often = often.withColumn("place", F.row_number().over(best)).where(F.col("place") <= PARTNERS)
    pairs = materialize(often.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")), "pairs")

    classes = facts.where("kind = 0 and key is not null")
    wanted = lists.select("key").distinct()
    copies = classes.groupBy("rk").agg(F.count("*").alias("copies")).where("copies > 1")
    chosen = classes.join(wanted, "key").groupBy("key").agg(F.min("rk").alias("rk"))
    chosen = materialize(chosen.join(copies, "rk", "left").withColumn("copies", F.coalesce("copies", F.lit(1))), "chosen")
    texts = materialize(_texts(rows.select("rk", "text"), chosen), "texts")
    discard_unheld(texts)
    discard(chosen)
    found = materialize(_verify(pairs, texts), "links")

    # the token-group matrix over the lists that hold more than one group
    grouped = components(found)
    asked = _ask(lists, grouped)
    probed = _probes(asked, grouped, pairs, PARTNERS)
    discard(asked)
    more = materialize(_verify(probed, texts), "links")
    before, grouped = grouped, components(found.unionByName(more))
    discard(before)
    rest = _ask(lists, grouped)
    discard(lists)
    single = _probes(rest.where("members = 1"), grouped, pairs.unionByName(probed))
    discard(pairs, probed)
    late = materialize(_verify(single, texts).unionByName(_open(rest.where("members > 1"), grouped, texts)), "links")
    discard(rest, single, grouped)
    del texts
    final = components(found.unionByName(more).unionByName(late))
    discard(found, more, late)

    joined = facts.where("kind = 0").join(final.withColumnRenamed("node", "key"), "key", "left")
    joined = joined.select("id", "rk", "n", "key", F.coalesce("component", "key").alias("group"))
    best = joined.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "rk")).alias("best"))
    out = joined.join(best, "group", "left")
    linked = F.col("group").isNotNull()
    out = out.select(
        "id",
        "rk",
        F.col("n").alias("n_shingles"),
        F.when(linked, F.col("best.id")).otherwise(F.col("id")).alias("component_id"),
        F.when(linked, F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.rk") == F.col("rk"))).otherwise(F.lit(True)).alias("first"),
    )
    out = materialize(out, "near-duplicates")
    discard(facts, final)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, one of each component; all columns stay, whatever their names.

    Texts without words all stay, but repeated rows do not.
    """
    own = uuid.uuid4().hex
    key, ident, place = f"key_{own}", f"id_{own}", f"place_{own}"
    found = near_duplicates(docs, id_col, text_col).where("first").select(F.col("id").alias(ident), F.col("rk").alias(f"{key}_first")).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)))
    same = F.col(key).eqNullSafe(F.col(f"{key}_first")) & F.col(id_col).cast("bigint").eqNullSafe(F.col(ident))
    kept = keyed.join(found, same).drop(ident, f"{key}_first")
    return kept.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))).where(F.col(place) == 1).drop(key, place)
