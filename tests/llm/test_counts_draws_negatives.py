"""Token counts, resampling and hard negatives against plain versions, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmesh.llm import hard_negatives, importance_resampling, queries, token_cache

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Names that the operators use or return.
CLASH = ["id", "digest", "rows", "n_bytes", "n_tokens", "over_limit", "rank", "score", "weight", "eligible", "_seq", "_segment", "_first", "label", "vec", "row", "slot", "anchor_id"]
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "  a  b   c ", "a\n b", "\n", "a \n", "x▁y ▁z", "▁", "</s> <s> <unk>", " x", "ﬁ ünï 😀 \x00 z",
    "<|endoftext|> a", "word " * 30_000, "x" * 70_000, " " * 5_000, "\t \t" * 999, "one▁ two",
]


def clashing(df, *own):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH if c not in own])


def texts_of(spark, texts):
    return clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4))


# token counts ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_the_librarys(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    if name.endswith(".model"):
        plain = [len(ids) for ids in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    else:
        tokenizer = Tokenizer.from_file(path)
        plain = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {r.id: r for r in token_cache.count_tokens(texts_of(spark, texts), path, str(tmp_path), over=100).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == plain
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(r.over_limit == (r.n_tokens > 100) for r in got.values())


def test_words_that_fill_the_memo(monkeypatch):
    monkeypatch.setattr(token_cache, "WORD_MEMO", 3)
    count = token_cache.load_counter(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for t in ODD] * 2 + ["a b c d e f a b", "b c"]
    assert count(texts) == [len(ids) for ids in model.encode(texts)]


def stored(spark, cache):
    return [(bytes(r.digest), r.n_tokens) for r in spark.read.option("recursiveFileLookup", "true").parquet(cache).collect()]


def test_only_distinct_misses_are_encoded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_cache, "HOT_ROWS", 5)
    cache = str(tmp_path)
    first = texts_of(spark, ["alpha beta"] * 40 + ["gamma", None, ""])
    one = sorted(tuple(r) for r in token_cache.count_tokens(first, PIECES, cache).collect())
    assert len(one) == 43 and len(stored(spark, cache)) == 3  # NULL and "" are one content
    # nothing is missing: nothing is appended, and the results are the same
    assert sorted(tuple(r) for r in token_cache.count_tokens(first, PIECES, cache).collect()) == one
    assert len(stored(spark, cache)) == 3
    # stored counts are used, not made again
    version = token_cache.tokenizer_digest(PIECES)
    known = hashlib.sha256(b"known text").digest()
    spark.createDataFrame([(known, 77), (known, 77)], token_cache.STORED).write.parquet(f"{cache}/{version}/more")
    more = texts_of(spark, ["gamma", "known text", "delta", "delta", "known text"])
    for misses in (token_cache.BROADCAST_MISSES, 0):
        monkeypatch.setattr(token_cache, "BROADCAST_MISSES", misses)
        got = {r.id: r.n_tokens for r in token_cache.count_tokens(more if misses else texts_of(spark, ["gamma", "known text", "eps", "eps", "known text"]), PIECES, cache).collect()}
        assert got[1] == got[4] == 77 and got[2] == got[3] < 5
    assert len(stored(spark, cache)) == 3 + 2 + 2
    # another tokenizer has counts of its own
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert {r.n_tokens for r in token_cache.count_tokens(texts_of(spark, ["known text"]), other, cache).collect()} == {2}


def test_counts_of_no_rows_and_repeated_rows(spark, tmp_path):
    assert token_cache.count_tokens(texts_of(spark, ["a"]).limit(0), PIECES, str(tmp_path)).count() == 0
    twice = spark.createDataFrame([(None, "b c"), (None, "b c"), (1, None)], "doc_id bigint, text string")
    got = token_cache.count_tokens(twice, PIECES, str(tmp_path)).collect()
    assert sorted((r.id or 0, r.n_tokens) for r in got) == [(0, 2), (0, 2), (1, 0)]


# resampling --------------------------------------------------------------------------------------------


def plain_resample(rows, target, percent, seed, min_words, n=1, buckets=10_000):
    def grams(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    s = collections.Counter(b for _, t in rows for b in grams(t)[1])
    t = collections.Counter(b for x in target for b in grams(x)[1])
    total_s, total_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, text in rows:
        words, found = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in found) // max(1, len(found))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_draw_equals_plain_version(spark, monkeypatch, n):
    monkeypatch.setattr(importance_resampling, "SAMPLES", 40)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(None, "Straße " * 25), (-5, "Émigré ÀB 12 " * 9), (900, None), (901, ""), (902, "-!-"), (3, "one two"), (2**40, "İstanbul " * 30)]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    frame = clashing(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7))
    benchmark = clashing(spark.createDataFrame([(t,) for t in target], "text string"))
    got = importance_resampling.resample(frame, benchmark, percent=30, seed=5, min_words=20, n=n)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, target, 30, 5, 20, n)


@pytest.mark.parametrize("parts,samples", [(1, 1), (3, 7), (9, 100_000)])
def test_ranks_with_ties_and_one_row_that_repeats(spark, monkeypatch, parts, samples):
    monkeypatch.setattr(importance_resampling, "SAMPLES", samples)
    monkeypatch.setattr(importance_resampling, "SEGMENT_ROWS", 50)
    r = random.Random(parts)
    rows = [(r.choice([None, *range(-40, 40)]), r.randint(-3, 3) * 10**r.randint(0, 15), r.random() < 0.8) for _ in range(900)] + [(7, 5, True)] * 600
    able = sorted((x for x in rows if x[2]), key=lambda x: (-x[1], x[0] is None, x[0] or 0))
    frame = spark.createDataFrame(rows, "id bigint, score bigint, eligible boolean").repartition(parts)
    for percent in (0, 37, 100):
        got = importance_resampling.rank_highest(frame, percent).collect()
        drawn = sorted((x for x in got if x.rank), key=lambda x: x.rank)
        take = len(able) * percent // 100
        assert [x.rank for x in drawn] == list(range(1, take + 1))
        assert [(x.id, x.score) for x in drawn] == [x[:2] for x in able[:take]]
        assert collections.Counter((x.id, x.score, x.eligible) for x in got) == collections.Counter(rows)


def test_a_repeated_row_is_split_among_segments(spark, monkeypatch):
    monkeypatch.setattr(importance_resampling, "SEGMENT_ROWS", 100)
    seen = {}
    real = importance_resampling.materialize
    monkeypatch.setattr(importance_resampling, "materialize", lambda df, name: seen.setdefault(name, real(df, name)))
    same = spark.range(4000).select(F.lit(1).cast("bigint").alias("id"), F.lit(2).cast("bigint").alias("score"), F.lit(True).alias("eligible")).repartition(4)
    ranked = importance_resampling.rank_highest(same, 100)
    assert ranked.select(F.sum("rank")).first()[0] == 4000 * 4001 // 2
    assert max(r["count"] for r in seen["segments"].groupBy("_segment").count().collect()) < 600


def test_resampling_of_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20)], "doc_id bigint, text string")
    none = docs.limit(0)
    assert importance_resampling.resample(none, docs, 10, 1).count() == 0
    assert [r.rank for r in importance_resampling.resample(docs, none, 100, 1).collect()] == [1]
    assert [r.rank for r in importance_resampling.resample(docs, none, 10, 1).collect()] == [None]


# hard negatives ----------------------------------------------------------------------------------------


def plain_mine(rows, positives, negatives, low, high):
    rows = [r for r in rows if None not in r[:3]]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, label, vec, anchor in rows:
        if anchor:
            near = sorted(((-dot(vec, v), j) for j, other, v, _ in rows if j != i and other == label))[:positives]
            far = sorted(((-dot(vec, v), j) for j, other, v, _ in rows if j != i and other != label))
            for p, positive in near:
                some = [(n, j) for n, j in far if low * -p <= 100 * -n <= high * -p][:negatives]
                out += [(i, positive, rank, j, -p, -n) for rank, (n, j) in enumerate(some, 1)]
    return sorted(out)


def vectors(seed, n, dims, top, spread=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        d = dims if r.random() < 0.9 else r.randint(0, dims)
        vec = [r.randint(-top, top) if r.random() < 0.8 else 0 for _ in range(d)]
        rows.append((i * spread, r.choice(["a", "b", "c"]), vec, i % 10 == 0))
    rows += [(n * spread + 1, None, [1], True), (n * spread + 2, "a", None, True), (None, "a", [1], True)]
    rows += [rows[0], rows[11], (5 * spread, "b", rows[5][2], None)]  # repeated rows and a repeated id
    return rows


@pytest.mark.parametrize("top,dims", [(3, 5), (40, 24), (2**29, 3)])  # the last has sums beyond 2**53
@pytest.mark.parametrize("limits", [{}, {"anchor_bytes": 500, "piece_rows": 60}])
def test_negatives_equal_brute_force(spark, monkeypatch, top, dims, limits):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 37)
    rows = vectors(top, 200, dims, top)
    frame = clashing(spark.createDataFrame(rows, "id bigint, label string, vec array<bigint>, anchor boolean"), "id", "label", "vec").repartition(5)
    for low, high in ((30, 90), (0, 100), (-50, 200)):
        got = hard_negatives.mine(frame, positives=3, negatives=4, low=low, high=high, **limits)
        assert sorted(map(tuple, got.collect())) == plain_mine(rows, 3, 4, low, high)


def test_bounds_close_before_all_dimensions_are_read(monkeypatch):
    r = np.random.default_rng(1)
    x = (r.standard_normal((64, 5000)) * 20 * np.linspace(3, 0.1, 64)[:, None]).astype(np.int64)
    block = hard_negatives.Block(list(range(5000)), ["a"] * 5000, x)
    read = []
    real = np.ix_
    monkeypatch.setattr(hard_negatives.np, "ix_", lambda d, rows: read.append(len(rows)) or real(d, rows))
    window = hard_negatives.Window(-(1 << 62), 1 << 62, 5)
    hard_negatives.scan(block, -1, x[:, 17], np.ones(5000, bool), [window])
    exact = x.T @ x[:, 17]
    assert window.ids.tolist() == np.lexsort((np.arange(5000), -exact))[:5].tolist()
    assert read[-1] < 500  # the last dimensions are read for a tenth of the rows at most


def test_negatives_of_a_uniform_label(spark):
    rows = [(i, "same", [1, 2], i < 2) for i in range(50)] + [(99, "other", [1, 1], False)]
    frame = spark.createDataFrame(rows, "id bigint, label string, vec array<bigint>, anchor boolean")
    got = sorted(map(tuple, hard_negatives.mine(frame).collect()))
    assert got == plain_mine(rows, 5, 10, 30, 90) and len(got) == 10
    assert hard_negatives.mine(frame.limit(0)).count() == 0
    assert hard_negatives.mine(frame.where("id >= 2")).count() == 0


def test_scaled_components(spark):
    data = [([0.5, -0.001],), ([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([],)]
    frame = spark.createDataFrame(data, "e array<float>")
    assert [r[0] for r in frame.select(hard_negatives.scaled(F.col("e"), 256)).collect()] == [[128, -1], None, None, None, None, []]


def test_queries_read_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.op11_token_counts(spark, SF).count() == docs
    assert queries.op12_importance_resampling(spark, SF).count() == docs
    assert queries.op13_hard_negatives(spark, SF).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
