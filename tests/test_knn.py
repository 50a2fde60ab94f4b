"""Nearest-neighbour operators against brute force."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import one
from pyspark.sql import functions as F

from quillmesh.functions.vectors import cosine_similarity, dimension_of
from quillmesh.operators import knn, topk_kernel
from quillmesh.operators.ann import ann_topk, recall_at_k
from quillmesh.operators.fusion import combine_results, rrf_fusion
from quillmesh.operators.knn import nearest
from quillmesh.operators.search import exclude_path, search_notes

DIM = 8


def cosine(a, b):
    if len(a) != len(b):
        return 0.0
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return 0.0 if n == 0 else float(np.dot(a, b) / n)


def brute(queries, items, k, *, tags=False, min_score=None, ordered=False):
    out = []
    for q in queries:
        found = []
        for i in items:
            if tags and q["tags"] and not set(q["tags"]) & set(i["tags"]):
                continue
            if ordered and i["pos"] >= q["pos"]:
                continue
            if len(q["query_vec"]) != len(i["content_vec"]):
                continue  # never a hit
            raw = cosine(q["query_vec"], i["content_vec"])
            if min_score is None or raw >= min_score:
                found.append((-(round(raw, 9) + 0.0), i["chunk_id"]))
        for r, (s, key) in enumerate(sorted(found)[:k], 1):
            out.append((q["query_id"], key, round(-s, 7) + 0.0, r))
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["chunk_id"], round(r["score"], 7) + 0.0, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(DIM)
    items = []
    for n in range(300):
        # A third of all items are the same vector, a third near copies, the rest random.
        v = base if n % 3 == 0 else base + 0.05 * rng.standard_normal(DIM) if n % 3 == 1 else rng.standard_normal(DIM)
        items.append({"chunk_id": f"c{n:03d}", "content_vec": [float(x) for x in v], "tags": [f"t{n % 4}"], "pos": n})
    items[7]["content_vec"] = [0.0] * DIM
    items[8]["content_vec"] = [1.0] * (DIM - 1)
    items[9]["tags"] = []
    queries = [
        {"query_id": n, "query_vec": [float(x) for x in (base if n == 0 else rng.standard_normal(DIM))],
         "tags": [] if n % 2 else ["t1", "zzz"], "pos": n * 20}
        for n in range(12)
    ]
    queries[5]["query_vec"] = [0.0] * DIM
    qs = "query_id bigint, query_vec array<double>, tags array<string>, pos bigint"
    it = "chunk_id string, content_vec array<double>, tags array<string>, pos bigint"
    return queries, items, spark.createDataFrame(queries, qs), spark.createDataFrame(items, it)


PLANS = [{}, {"broadcast_rows": 3}, {"broadcast_rows": 3, "broadcast_items": 4, "query_tile": 5, "item_tile": 40}]


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("k", [1, 7, 500])
def test_topk(data, plan, k):
    q, i, qdf, idf = data
    assert rows(nearest(qdf, idf, k, **plan)) == brute(q, i, k)


@pytest.mark.parametrize("plan", PLANS)
def test_tags_threshold_and_order(data, plan):
    q, i, qdf, idf = data
    assert rows(nearest(qdf, idf, 9, query_tags="tags", item_tags="tags", **plan)) == brute(q, i, 9, tags=True)
    assert rows(nearest(qdf, idf, 9, min_score=0.8, **plan)) == brute(q, i, 9, min_score=0.8)
    assert rows(nearest(qdf, idf, 9, query_order="pos", item_order="pos", **plan)) == brute(q, i, 9, ordered=True)


def test_empty_sides(data):
    _, _, qdf, idf = data
    assert nearest(qdf, idf.limit(0), 3).count() == 0
    assert nearest(qdf.limit(0), idf, 3).count() == 0


def test_ann_cuts_crowded_buckets_without_losing_rows(spark, data):
    q, i, qdf, idf = data
    whole = ann_topk(qdf, idf, 5, dim=DIM, bands=6, bits=3)
    cut = ann_topk(qdf, idf, 5, dim=DIM, bands=6, bits=3, query_tile=2, item_tile=10)
    assert rows(whole) == rows(cut)
    exact = nearest(qdf, idf, 5, min_score=0.9)
    r = recall_at_k(whole, exact).first()
    assert r["expected"] > 0 and r["recall"] > 0.9


def test_cosine_column(spark):
    c = lambda a, b: one(spark, cosine_similarity(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert c([1.0, 0.0], [1.0, 1.0]) == pytest.approx(0.70710678)
    assert c([1.0], [1.0, 1.0]) == 0.0
    assert c([0.0, 0.0], [1.0, 1.0]) == 0.0


def test_dimension_lookup(spark):
    d = lambda m, p, n=None: one(spark, dimension_of(F.lit(m), F.lit(p), None if n is None else F.lit(n)))
    assert (d("bge-m3:latest", "ollama"), d("x", "ollama"), d("x", "openai"), d("", "openai")) == (1024, 768, 1536, 768)
    assert (d("x", "openai", 99), d("x", "openai", 0)) == (99, 1536)


def fused(spark, lists, limit=10, **kw):
    ranked = [(1, s, i, r) for s, ids in lists.items() for r, i in enumerate(ids, 1)]
    df = spark.createDataFrame(ranked, "query_id int, vec_name string, chunk_id string, rank int")
    return [(r["chunk_id"], r["score"]) for r in rrf_fusion(df, list(lists), limit, **kw).orderBy("rank").collect()]


def test_rrf_scores_and_ties(spark):
    got = fused(spark, {"a": ["x", "y", "z"], "b": ["z", "w"]})
    assert [i for i, _ in got] == ["z", "x", "y", "w"]
    assert got[0][1] == 1 / 63 + 1 / 61
    # Equal scores: the item of the earlier set comes first.
    assert [i for i, _ in fused(spark, {"a": ["q"], "b": ["p"]})] == ["q", "p"]
    assert [i for i, _ in fused(spark, {"b": ["p"], "a": ["q"]})] == ["p", "q"]
    assert fused(spark, {"a": ["q"], "b": ["q"]}, k=1) == [("q", 1.0)]
    assert len(fused(spark, {"a": list("abcdef"), "b": []}, limit=2)) == 2


def test_combine_prefers_hot_rows(spark):
    s = "query_id int, chunk_id string, score double, rank int"
    hot = spark.createDataFrame([(1, "a", 0.2, 1), (1, "b", 0.01, 2)], s)
    stored = spark.createDataFrame([(1, "a", 0.9, 1), (1, "c", 0.2, 2), (1, "d", 0.005, 3)], s)
    got = [(r["chunk_id"], r["score"], r["source"]) for r in combine_results(hot, stored, 3).orderBy("rank").collect()]
    assert got == [("a", 0.2, 0), ("c", 0.2, 1), ("b", 0.01, 0)]


def test_exclusion_happens_after_the_limit(spark):
    v = [[1.0, 0.0], [0.9, 0.1], [0.5, 0.5], [0.1, 0.9]]
    index = spark.createDataFrame(
        [(f"f{n // 2}-chunk-{n}", f"d/f{n // 2}.md", "", "c" * 150, "", x, x, x) for n, x in enumerate(v)],
        "chunk_id string, file_path string, header_path string, content string, summary string, "
        "content_vec array<double>, summary_vec array<double>, title_vec array<double>",
    )
    q = spark.createDataFrame([(1, v[0], "d/f0.md")], "query_id int, query_vec array<double>, exclude_path string")
    assert search_notes(q, index, 2).count() == 0
    more = search_notes(q, index, 2, exclude_before_limit=True).orderBy("rank").collect()
    assert [(r["note_path"], r["title"], len(r["excerpt"])) for r in more] == [("d/f1.md", "f1.md", 100)] * 2
    # a note with many chunks near itself still leaves a full list
    many = index.unionByName(index.limit(1).select(F.explode(F.sequence(F.lit(100), F.lit(140))).alias("n"), "*").withColumn(
        "chunk_id", F.concat(F.lit("f0-chunk-"), "n")).drop("n"))
    assert search_notes(q, many, 2, exclude_before_limit=True).count() == 2
    hits = spark.createDataFrame([(1, "d/f0.md")], "query_id int, file_path string")
    assert exclude_path(hits, q).count() == 0


@pytest.mark.parametrize("plan", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "broadcast_items": 0}])
def test_unusable_vectors_and_raw_thresholds(spark, plan):
    v = [[-1.0, 0.1], None, [1.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    items = spark.createDataFrame([(f"c{n}", x) for n, x in enumerate(v)], "chunk_id string, content_vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vec array<double>")
    assert [r["chunk_id"] for r in nearest(q, items, 2, **plan).collect()] == ["c0"]
    near = spark.createDataFrame([("a", [0.8999999997, (1 - 0.8999999997**2) ** 0.5])], "chunk_id string, content_vec array<double>")
    assert nearest(q, near, 1, min_score=0.9, **plan).count() == 0
    assert nearest(q, near, 1, min_score=0.8999999996, **plan).count() == 1


def test_items_are_not_copied_for_a_few_queries_each():
    # a session may claim far more cores than there are queries worth a copy of all items
    many = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(defaultParallelism=1000)))
    assert knn.tasks_for(many, 100_000) <= 100_000 // 2048
    assert knn.tasks_for(many, 100) == 1
    assert knn.tasks_for(many, 10 * knn.TILE_ROWS[1]) >= 10


def test_packed_blocks_hold_every_row_in_order(spark):
    rows = [(f"k{n:04d}" if n else None, [float(n), 1.0] if n % 5 else None) for n in range(2500)]
    items = spark.createDataFrame(rows, "chunk_id string, content_vec array<double>").repartition(7)
    blocks = knn._packed(items, ["chunk_id"]).orderBy("_at").collect()
    tables = [pa.ipc.open_stream(b["_block"]).read_all() for b in blocks]
    assert max(t.num_rows for t in tables) <= topk_kernel.ITEM_BLOCK
    got = pa.concat_tables(tables).to_pylist()
    assert [(r["chunk_id"], r["content_vec"]) for r in got] == [*rows[1:], rows[0]]
