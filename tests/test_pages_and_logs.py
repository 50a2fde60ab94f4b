"""Stored pages, the bucketed log, bounded related notes, totals taken while writing, single evaluation."""

import random
import time

import pytest
from conftest import one
from pyspark.sql import functions as F

from quillmesh.functions import spans as sp
from quillmesh.operators import chunking
from quillmesh.operators import concepts as con
from quillmesh.operators import registry as reg
from quillmesh.plans import indexing
from quillmesh.session import discard
from quillmesh.sources import bucketed_log as blog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# pages -----------------------------------------------------------------------------------------------------


def concepts(spark, n):
    return spark.range(n).repartition(7).selectExpr("format_string('c%05d', id) concept", "'s' summary", "array(1f) concept_vec", "array(1f) concept_summary_vec")


@pytest.mark.parametrize("n,limit", [(1234, 100), (100, 100), (3, 1), (0, 10)])
def test_pages_cover_every_concept_once(spark, n, limit):
    pages = reg.store_pages(concepts(spark, n), limit)
    got = [[r.concept for r in reg.read_page(pages, p).collect()] for p in range(1, -(-n // limit) + 2)]
    names = [f"c{i:05d}" for i in range(n)]
    assert got == [names[i : i + limit] for i in range(0, n, limit)] + [[]]
    assert sorted((r.page, r.concept) for r in pages.rows.collect()) == [(i // limit + 1, c) for i, c in enumerate(names)]
    assert sorted((r.page, r.concepts) for r in pages.bounds.collect()) == [(i + 1, len(p)) for i, p in enumerate(got[:-1])]


def test_a_page_reads_its_own_range(spark):
    plan = plan_of(reg.read_page(reg.store_pages(concepts(spark, 1000)), 4))
    assert "GreaterThanOrEqual(concept,c00300), LessThanOrEqual(concept,c00399)" in plan


# bucketed log ----------------------------------------------------------------------------------------------

SCHEMA = "chunk_id string, file_path string, content string, vec array<float>, version bigint, deleted boolean"


def log_with_history(spark, tmp_path, name):
    blog.open_log(spark, name, f"{tmp_path}/log", SCHEMA, 4)
    rows = spark.range(60).selectExpr("concat('k', id) chunk_id", "concat('f', id % 7) file_path", "concat('v', id) content", "array(cast(id as float)) vec")
    blog.append_upserts(rows, name, F.lit(0))
    blog.append_upserts(rows.where("vec[0] % 3 = 0").withColumn("content", F.lit("new")), name, F.lit(2))
    blog.append_tombstones(rows.where("vec[0] % 4 = 0").select("chunk_id"), name, F.lit(1))
    blog.append_upserts(rows.where("vec[0] % 3 = 0").withColumn("content", F.lit("new")), name, F.lit(2))  # once more
    blog.append_tombstones(rows.where("vec[0] = 1").unionByName(rows.where("vec[0] = 1")), name, F.lit(5))
    # the tombstone of version 1 is older than the upsert of version 2
    return {f"k{i}": "new" if i % 3 == 0 else f"v{i}" for i in range(60) if i != 1 and (i % 3 == 0 or i % 4)}


def test_current_rows_need_no_exchange(spark, tmp_path):
    want = log_with_history(spark, tmp_path, "log_a")
    now = blog.current(spark, "log_a")
    assert {r.chunk_id: r.content for r in now.collect()} == want
    assert "Exchange" not in plan_of(now)
    # nor does a join with another table of the same buckets
    other = blog.current(spark, "log_a").select("chunk_id", F.col("content").alias("c"))
    assert "Exchange" not in plan_of(now.hint("merge").join(other, "chunk_id"))


def test_compaction_goes_bucket_by_bucket(spark, tmp_path):
    want = log_with_history(spark, tmp_path, "log_b")
    opened = blog.current(spark, "log_b")
    before = blog.compact(spark, "log_b", F.lit(9))
    assert {r.chunk_id: r.content for r in blog.current(spark, "log_b").collect()} == want
    assert spark.table("log_b").count() == len(want)
    assert len(spark.table("log_b").inputFiles()) <= 4
    assert "Exchange" not in plan_of(blog.current(spark, "log_b"))
    # a reader from before still has its files, and the log goes on
    assert {r.chunk_id: r.content for r in opened.collect()} == want and before.endswith("/log")
    blog.append_tombstones(spark.createDataFrame([("k2",)], "chunk_id string"), "log_b", F.lit(10))
    assert blog.current(spark, "log_b").count() == len(want) - 1
    blog.compact(spark, "log_b", F.lit(11))
    assert spark.table("log_b").count() == len(want) - 1


def test_an_empty_log(spark, tmp_path):
    blog.open_log(spark, "log_c", f"{tmp_path}/log", SCHEMA, 4)
    assert blog.current(spark, "log_c").count() == 0
    blog.compact(spark, "log_c", F.lit(0))
    assert blog.current(spark, "log_c").count() == 0


# related notes ---------------------------------------------------------------------------------------------


def notes_with_links(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        links = [r.choice("abcdefghij") + str(r.randint(0, 4)) for _ in range(r.randint(0, 4))]
        links += ["everywhere"] * (r.random() < 0.5) + ["popular"] * r.choice([0, 0, 1, 2])
        r.shuffle(links)
        rows.append((f"n{i:04d}", links if r.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("targets", [10_000, 0])
@pytest.mark.parametrize("limit", [1, 3, 50])
def test_related_notes_with_closed_links(spark, monkeypatch, targets, limit):
    rows = notes_with_links(limit, 150)
    df = spark.createDataFrame(rows, "note_path string, me_concepts array<string>").repartition(3)
    get = lambda d: sorted((r.target_path, r.rank, r.note_path, tuple(r.shared), r.shared_count) for r in d.collect())
    want = get(con.related_by_concept(df, df).where(F.col("rank") <= limit))
    assert get(con.related_by_concept(df, df, limit)) == want
    monkeypatch.setattr(con, "BROADCAST_TARGETS", targets)
    for mentions in (3, 20, 60):
        monkeypatch.setattr(con, "POPULAR_MENTIONS", mentions)
        assert get(con.related_by_concept(df, df, limit)) == want


def test_a_link_of_half_the_notes_stays_closed(spark, monkeypatch):
    monkeypatch.setattr(con, "POPULAR_MENTIONS", 500)
    # each group of eight shares three links of its own; one link is in every second note
    rows = [(f"n{i:05d}", [f"g{i // 8}", f"h{i // 8}", f"k{i // 8}"] + ["hub"] * (i % 2)) for i in range(4000)]
    df = spark.createDataFrame(rows, "note_path string, me_concepts array<string>")
    met = []
    monkeypatch.setattr(con, "_pairs", lambda *a, real=con._pairs: met.append(real(*a)) or met[-1])
    got = con.related_by_concept(df, df, 5)
    assert got.count() == 4000 * 5
    assert sum(p.count() for p in met) < 4000 * 8 * 3  # with the hub there are four million
    top = {r.note_path: r.shared_count for r in got.where("target_path = 'n00001'").collect()}
    assert top == {"n00003": 4, "n00005": 4, "n00007": 4, "n00000": 3, "n00002": 3}


# totals and evaluation -------------------------------------------------------------------------------------


def test_totals_are_taken_while_writing(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[1.0] for _ in texts]

    notes = spark.createDataFrame([("a.md", "one two"), ("b.md", "# H\nbad text"), ("c.md", " ")], "note_path string, content string")
    answers = spark.createDataFrame([("a.md", 0, '{"concepts":["X","Y"]}')], "note_path string, index int, response string")
    done = indexing.index_notes(notes, answers, embed, F.lit(1))
    assert done.totals == {"notes": 2, "chunks": 2, "failed_chunks": 1, "concepts": 2, "characters": 19}
    assert done.rows.count() == 1
    empty = indexing.index_notes(notes.limit(0), answers, embed, F.lit(1))
    assert set(empty.totals.values()) == {0}
    discard(done.rows)


def test_spans_are_evaluated_once(spark):
    notes = spark.createDataFrame([("a.md", "x\ny")], "note_path string, content string")
    answers = spark.createDataFrame([("a.md", "{}")], "note_path string, response string")
    plan = chunking.span_chunks(notes, answers)._jdf.queryExecution().optimizedPlan().toString()
    # one parse of the answer and one masking of the note
    assert plan.count("[frontmatter]") == 1 and plan.count("chunks") <= 2
    assert "size(cut" not in plan


def test_many_spans_merge_in_linear_time(spark):
    def merged(n):
        rows = spark.range(1).select(
            F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(
                F.concat(F.lit("t"), i).alias("title"), (i * 2.0).alias("start_line"), (i * 2.0 + F.when(i % 3 == 0, 2.0).otherwise(1.0)).alias("end_line"),
                F.lit("").alias("header_path"))).cast(f"array<{sp.SPAN}>").alias("s")
        )
        start = time.time()
        found = rows.select(F.size(sp.merge_spans(F.col("s")))).first()[0]
        return found, time.time() - start

    merged(10)
    small, large = merged(2_000), merged(20_000)
    assert large[0] == 20_000 - 20_000 // 3 and small[0] == 2_000 - 2_000 // 3
    assert large[1] < 10


def test_merged_spans(spark):
    spans = [("a", 1.0, 3.0, "p"), ("b", 3.0, 4.0, ""), ("c", 5.0, 9.0, ""), ("d", 6.0, 7.0, ""), ("e", 10.0, 10.0, "")]
    rows = spark.createDataFrame([(spans,), ([],), (spans[:1],)], f"s array<{sp.SPAN}>")
    got = [[tuple(x) for x in r[0]] for r in rows.select(sp.merge_spans(F.col("s"))).collect()]
    assert got == [[("a", 1.0, 4.0, "p"), ("c", 5.0, 9.0, ""), ("e", 10.0, 10.0, "")], [], [("a", 1.0, 3.0, "p")]]
    assert one(spark, F.lit(1)) == 1
