"""Lists around centres: exact searches, the inverted file, threshold edges, and leaders against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import registry as reg
from quillmesh.operators import search, tiles
from quillmesh.operators.knn import nearest


def frame(spark, vectors, key="chunk_id", vec="content_vec"):
    rows = [(f"k{i:05d}", None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{key} string, {vec} array<double>").repartition(4)


def clustered(seed, groups, members, dim=12, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return np.concatenate([c + spread * rng.standard_normal((members, dim)) for c in centres])


def prepared(spark, vectors, count):
    items = frame(spark, vectors)
    lists = tiles.fit_lists(items, "content_vec", "chunk_id", count=count)
    stored = tiles.into_lists(items, "content_vec", lists)
    return items, stored, tiles.with_radii(lists, stored)


def queries_of(items, n):
    return items.orderBy("chunk_id").limit(n).select(F.col("chunk_id").alias("query_id"), F.col("content_vec").alias("query_vec"))


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())



ODD = [None, [], [1.0], [0.0] * 12, [float("nan")] * 12]


@pytest.mark.parametrize("piece_rows,first", [(4096, 1), (7, 3)])
def test_tiled_search_is_exact_and_skips_lists(spark, monkeypatch, piece_rows, first):
    monkeypatch.setattr(tiles, "meet", lambda *a, real=tiles.meet, **k: real(*a, rows=piece_rows))
    items, stored, lists = prepared(spark, [*clustered(1, 12, 25), *ODD], 12)
    queries = queries_of(items, 300).unionByName(spark.createDataFrame([("zero", [0.0] * 12), ("none", None), ("other", [1.0, 2.0])], "query_id string, query_vec array<double>"))
    exact = nearest(queries, items, 6).where(~F.col("query_id").isin("other"))
    got = tiles.tiled_topk(queries, stored, lists, 6, first=first)
    assert rows(got) == rows(exact)
    share = tiles.skipped_share(queries_of(items, 300), stored, lists, 6, first=first).first()
    assert share["pairs"] == 300 * stored.count() and share["skipped"] > 0.5


def test_a_few_items_open_everything(spark):
    items, stored, lists = prepared(spark, clustered(2, 3, 2), 3)
    assert rows(tiles.tiled_topk(queries_of(items, 6), stored, lists, 10)) == rows(nearest(queries_of(items, 6), items, 10))
    empty = items.limit(0)
    none = tiles.fit_lists(empty, "content_vec", "chunk_id")
    assert tiles.ivf_topk(queries_of(items, 6), tiles.into_lists(empty, "content_vec", none), none, 3, 2).count() == 0


def test_inverted_file_and_its_curve(spark):
    vectors = np.random.default_rng(3).standard_normal((600, 12))
    items, stored, lists = prepared(spark, vectors, 24)
    queries = queries_of(items, 80)
    exact = {(r["query_id"], r["chunk_id"]) for r in nearest(queries, items, 10).collect()}
    curve = {r["probes"]: r for r in tiles.recall_curve(queries, stored, lists, 10).collect()}
    sizes = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}
    assert len(curve) == len(lists.centres) and curve[24]["recall"] == 1 and curve[24]["pair_share"] == 1
    unit = vectors[:80] / np.linalg.norm(vectors[:80], axis=1, keepdims=True)
    for probes in (1, 5, 24):
        found = tiles.ivf_topk(queries, stored, lists, 10, probes)
        hits = {(r["query_id"], r["chunk_id"]) for r in found.collect()} & exact
        assert curve[probes]["recall"] == pytest.approx(len(hits) / len(exact))
        opened = np.argsort(-np.round(unit @ lists.centres.T, 9), axis=1, kind="stable")[:, :probes]
        assert curve[probes]["pair_share"] == pytest.approx(sum(sizes.get(int(c), 0) for c in opened.ravel()) / (80 * 600))
    enough = tiles.probes_for(tiles.recall_curve(queries, stored, lists, 10), 0.9)
    assert curve[enough]["recall"] >= 0.9 > curve[enough - 1]["recall"]


def test_sample_is_bounded_and_does_not_follow_the_layout(spark):
    items = frame(spark, clustered(4, 10, 400))
    a = tiles.fit_lists(items, "content_vec", "chunk_id", count=10, sample_rows=300)
    b = tiles.fit_lists(items.repartition(9).orderBy(F.desc("chunk_id")), "content_vec", "chunk_id", count=10, sample_rows=300)
    assert a.centres.shape == (10, 12) and (a.centres == b.centres).all()


def test_lists_are_stored_in_order(spark):
    _, stored, _ = prepared(spark, clustered(5, 8, 200), 8)
    assert "PushedFilters: [In(list, [1,2]" in stored.where(F.col("list").isin(1, 2))._jdf.queryExecution().toString()
    spread = stored.groupBy(F.input_file_name()).agg(F.min("list").alias("a"), F.max("list").alias("b")).collect()
    assert sum(r["b"] - r["a"] for r in spread) <= 8  # files follow each other


def test_fused_search_over_tiles(spark):
    rng = np.random.default_rng(8)
    sets = [clustered(s, 6, 30) for s in (11, 12, 13)]
    tags = [["a"], ["b"], ["a", "b"], [], None]
    data = [(f"k{i:03d}", *[[float(x) for x in m[i]] for m in sets], tags[i % 5]) for i in range(180)]
    index = spark.createDataFrame(data, "chunk_id string, content_vec array<double>, summary_vec array<double>, title_vec array<double>, tags array<string>")
    asked = [(i, [float(x) for x in rng.standard_normal(12)] if i % 3 else data[i][1], tags[i % 4]) for i in range(40)]
    queries = spark.createDataFrame(asked, "query_id int, query_vec array<double>, tags array<string>")
    made = search.search_tiles(index, count=6)
    for own in ("tags", None):
        plain = search.fused_search(queries, index, 5, query_tags=own)
        got = search.tiled_fused_search(queries, made, 5, query_tags=own)
        assert rows(got) == rows(plain)


# leaders ---------------------------------------------------------------------------------------------------


def one_by_one(vectors, threshold=0.9):
    leaders, kept = [], np.zeros((0, len(vectors[0])))
    for i, v in enumerate(vectors):
        norm = np.linalg.norm(v)
        if norm == 0 or not len(kept) or (kept @ (v / norm)).max() < threshold:
            leaders.append(i)
            if norm:
                kept = np.vstack([kept, v / norm])
    return leaders


def candidates(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "ord bigint, name_vec array<double>").repartition(5)


def elected(df, **options):
    return sorted(r["ord"] for r in reg.elect_leaders(df, **options).collect())


@pytest.mark.parametrize("seed,spread", [(1, 0.1), (2, 0.25), (3, 0.4)])
@pytest.mark.parametrize("neighbours,task_edges,list_rows", [(16, 2_000_000, 2048), (1, 50, 40), (3, 10**6, 40)])
def test_leaders_equal_one_by_one(spark, monkeypatch, seed, spread, neighbours, task_edges, list_rows):
    monkeypatch.setattr(reg, "TASK_EDGES", task_edges)
    monkeypatch.setattr(reg, "LIST_ROWS", list_rows)
    monkeypatch.setattr(reg, "BROADCAST_CANDIDATES", 10_000 if list_rows > 1000 else 100)
    vectors = np.random.default_rng(seed).permutation(clustered(seed, 6, 60, 8, spread))
    vectors[7] = 0
    vectors[30] = vectors[3]
    assert elected(candidates(spark, vectors), neighbours=neighbours) == one_by_one(vectors)


def test_a_chain_takes_one_pass(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(reg, "_decide", lambda *a, real=reg._decide: passes.append(1) or real(*a))
    monkeypatch.setattr(reg, "nearest", None)  # no search runs in the election
    monkeypatch.setattr(reg, "BROADCAST_CANDIDATES", 50)
    monkeypatch.setattr(reg, "LIST_ROWS", 40)
    # each vector is near the one before and the one after it, and no other
    vectors = np.eye(200, 201) + np.eye(200, 201, 1)
    assert elected(candidates(spark, vectors), threshold=0.5 - 1e-9) == list(range(0, 200, 2))
    assert len(passes) == 1


def test_a_large_group_has_edges_in_proportion(spark, monkeypatch):
    edges = []
    real = reg.earliest_near

    def counted(*a):
        found = real(*a)
        edges.append(found.count())
        return found

    monkeypatch.setattr(reg, "earliest_near", counted)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal(16) + 1e-3 * rng.standard_normal((20_000, 16))
    assert elected(candidates(spark, vectors)) == [0]
    assert len(edges) == 1 and edges[0] <= 16 * 20_000
