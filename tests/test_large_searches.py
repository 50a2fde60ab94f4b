"""What searches over large tables rest on: sides computed once, blocks stored once, few queries where few are enough."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.functions.vectors import hash_embedding
from quillmesh.operators import knn, search, tiles, topk_kernel
from quillmesh.operators import registry as reg
from quillmesh.operators.knn import nearest

BIG = {"broadcast_rows": 0, "broadcast_items": 0}


def plain(text, dim):
    counts = [0] * dim
    for word in text.lower().replace("\n", " ").split(" "):
        if word:
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim] += 1
    norm = sum(c * c for c in counts) ** 0.5
    return [c / norm if norm else 0.0 for c in counts]


def test_words_are_counted_in_arrow_tasks(spark):
    texts = ["a b\nA  b\tc", "", " \n ", "读书 é", "x " * 5000]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", hash_embedding(F.col("t"), 7).alias("v"))
    assert {r["t"]: r["v"] for r in df.collect()} == {**{t: plain(t, 7) for t in texts}, None: None}
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()


def counted(spark, df, column):
    """The table with a column that counts how often it is computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def same(v):
        seen.add(1)
        return v

    return df.withColumn(column, same.asNondeterministic()(column)), seen


def vectors(spark, n, seed=0, dim=6):
    rows = [(f"k{i:04d}", [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(seed).standard_normal((n, dim)))]
    return spark.createDataFrame(rows, "chunk_id string, content_vec array<double>")


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def test_sides_are_computed_once_and_blocks_stored_once(spark, monkeypatch):
    items = vectors(spark, 90)
    queries = items.select(F.col("chunk_id").alias("query_id"), F.col("content_vec").alias("query_vec"))
    (dear_q, q_seen), (dear_i, i_seen) = counted(spark, queries, "query_vec"), counted(spark, items, "content_vec")
    found = nearest(dear_q, dear_i, 4, **BIG, query_tile=20)
    assert ranked(found) == ranked(nearest(queries, items, 4))
    # one more look at the queries is for their bytes
    assert i_seen.value == 90 and q_seen.value <= 180
    assert "_block" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(knn, "stored_files", lambda blocks: None)
    assert ranked(nearest(queries, items, 4, **BIG, query_tile=20)) == ranked(nearest(queries, items, 4))


def test_equal_vectors_beyond_k_are_not_looked_at(spark):
    same = pa.array([[1.0, 0.0]] * 5 + [[0.0, 1.0], None, [1.0, 0.0]])
    assert topk_kernel.Repeated(2).without(same).to_pylist() == [[1.0, 0.0]] * 2 + [None] * 3 + [[0.0, 1.0], None, None]
    rows = [(f"k{i:04d}", [1.0, 0.0] if i % 3 else [0.0, 1.0], "a" if i < 10 else "b") for i in range(60)]
    items = spark.createDataFrame(rows, "chunk_id string, content_vec array<double>, file string")
    queries = spark.createDataFrame([(1, [1.0, 0.1], "a"), (2, [0.0, 1.0], None)], "query_id int, query_vec array<double>, own string")
    for group in ({}, {"query_group": "own", "item_group": "file"}):
        want = ranked(nearest(queries, items, 4, **group))
        assert ranked(nearest(queries, items, 4, **BIG, **group)) == want
        assert ranked(nearest(queries, items, 4, broadcast_rows=0, **group)) == want


@pytest.mark.parametrize("plan", [{}, {"broadcast_rows": 0}, BIG])
def test_reasons_are_looked_for_only_where_names_leave_it_open(spark, monkeypatch, plan):
    rng = np.random.default_rng(3)
    concepts, other = rng.standard_normal((40, 8)), rng.standard_normal((40, 8))
    known = [(f"C{i:02d}", f"about {i}", [float(x) for x in concepts[i]], [float(x) for x in other[i]]) for i in range(40)]
    registry = spark.createDataFrame([*known, ("C99", "twin", *known[3][2:])], "concept string, summary string, concept_vec array<double>, concept_summary_vec array<double>")
    rows = []
    for i in range(40):
        name = concepts[i] + (0.05 if i % 4 == 0 else 0.8) * rng.standard_normal(8)
        reason = other[i] + (0.1 if i % 2 else 5.0) * rng.standard_normal(8)
        rows.append((i, f"T{i}", f"why {i}", [float(x) for x in name], [float(x) for x in reason]))
    rows += [(50, "T50", "no reason", rows[1][3], None), (51, "T51", "no name", None, rows[1][4])]
    incoming = spark.createDataFrame(rows, "ord bigint, name string, reason string, name_vec array<double>, reason_vec array<double>")
    calls = []
    monkeypatch.setattr(reg, "nearest", lambda q, *a, **k: calls.append((q.count(), len(k["vectors"]))) or nearest(q, *a, **k))
    out = lambda: sorted(tuple(r) for r in reg.register_or_match(incoming, registry, **plan).collect())
    got = out()
    kinds = [r[-1] for r in got]
    assert min(kinds.count(k) for k in ("strict", "loose", "new")) > 0
    assert calls[0] == (42, 1) and calls[1] == (41 - kinds.count("strict"), 1)
    monkeypatch.setattr(reg, "_nearest_on_both", reg._two_of_each)
    assert out() == got


def test_tiles_compute_vectors_once_and_find_reached_lists_in_tasks(spark):
    items = vectors(spark, 80)
    index = items.select("chunk_id", *[F.col("content_vec").alias(c) for c in search.VECTOR_COLUMNS])
    dear, seen = counted(spark, index, "content_vec")
    search.search_tiles(dear, tags=None, count=5)
    assert seen.value == 80
    lists = tiles.fit_lists(items, "content_vec", "chunk_id", count=5)
    lists = tiles.with_radii(lists, tiles.into_lists(items, "content_vec", lists))
    asked = items.withColumn("_reach", F.lit(0.4)).withColumn("_done", F.array(F.lit(1)))
    want = {r["chunk_id"]: sorted(r["lists"]) for r in tiles.route(asked, "content_vec", lists, reach="_reach").collect()}
    table = asked.select("chunk_id", "content_vec", "_reach", F.col("_done").alias("lists")).toArrow()
    opened = topk_kernel.reached(lists.centres, lists.radii, "content_vec", "_reach")(table)
    assert {k: list(np.flatnonzero(row)) for k, row in zip(table.column("chunk_id").to_pylist(), opened, strict=True)} == {k: [x for x in v if x != 1] for k, v in want.items()}
