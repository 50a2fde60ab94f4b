"""Forms for scale of the searches: tiles of queries, ties and lists."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import tiles
from quillmesh.operators.knn import nearest


def table(spark, key, vec, vectors, first=0):
    rows = [(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{key} bigint, {vec} array<double>")


def test_queries_of_one_partition_spread_over_tasks(spark):
    vectors = np.random.default_rng(1).standard_normal((3000, 4))
    q, i = table(spark, "query_id", "query_vec", vectors).coalesce(1), table(spark, "chunk_id", "content_vec", vectors[:20])
    found = nearest(q, i, 1, broadcast_rows=0)
    tasks = found.select(F.spark_partition_id().alias("t"), "query_id").distinct().groupBy("t").count()
    assert tasks.agg(F.max("count")).first()[0] < 3000
    assert found.count() == 3000


@pytest.mark.parametrize("plan", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "broadcast_items": 0, "query_tile": 50}])
def test_equal_scores_rank_by_key_over_many_blocks(spark, plan):
    rng = np.random.default_rng(2)
    kinds = rng.integers(-1, 2, (6, 3)).astype(float)
    items = kinds[rng.integers(0, 6, 2500)]
    asked = [*kinds, [0.3, 0.2, -1.0], [0.0] * 3, None]
    i = table(spark, "chunk_id", "content_vec", items).repartition(7)
    found = nearest(table(spark, "query_id", "query_vec", asked), i, 15, **plan)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))

    def unit(m):
        n = np.linalg.norm(m, axis=-1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit(np.array(asked[:-1])) @ unit(items).T, 9) + 0.0
    for n, row in enumerate(scores):
        best = sorted(range(len(row)), key=lambda c: (-row[c], c))[:15]
        assert [c for c, _ in got[n]] == best
        assert [s for _, s in got[n]] == pytest.approx([row[c] for c in best], abs=2e-9)
    assert len(asked) - 1 not in got


def test_a_query_moves_once_however_many_lists_it_opens(spark):
    vectors = np.random.default_rng(3).standard_normal((500, 6))
    items = table(spark, "chunk_id", "content_vec", vectors)
    lists = tiles.fit_lists(items, "content_vec", "chunk_id", count=20)
    stored = tiles.into_lists(items, "content_vec", lists)
    queries = items.select(F.col("chunk_id").alias("query_id"), F.col("content_vec").alias("query_vec"))
    found = tiles.ivf_topk(queries, stored, lists, 5, 20)
    assert "explode(lists" not in found._jdf.queryExecution().toString()
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    assert key(found) == key(nearest(queries, items, 5))


def test_earliest_near_rows_come_by_their_number(spark):
    rng = np.random.default_rng(4)
    vectors = np.repeat(rng.standard_normal((3, 5)), 400, axis=0)[rng.permutation(1200)] + 0.01 * rng.standard_normal((1200, 5))
    numbers = rng.permutation(5000)[:1200]
    rows = spark.createDataFrame([(int(n), [float(x) for x in v]) for n, v in zip(numbers, vectors, strict=True)], "ord bigint, vec array<double>")
    others = rows.select(F.col("ord").alias("other"), "vec")
    lists = tiles.fit_lists(others, "vec", "other", count=12)
    found = {}
    for r in tiles.earliest_near(rows, tiles.into_lists(others, "vec", lists), 0.9, 4, lists).collect():
        found.setdefault(r["ord"], []).append(r["other"])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    for at, n in enumerate(numbers):
        assert sorted(found.get(int(n), [])) == sorted(int(m) for m in numbers[near[at]] if m < n)[:4]
