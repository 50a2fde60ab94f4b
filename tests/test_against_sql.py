"""Random adversarial notes, and registered queries, against DuckDB."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import links
from quillmesh.functions import markdown as md
from quillmesh.operators.chunking import chunk_notes
from workload import catalog
from workload import inputs_sql as sql
from workload import text_queries as tq

SF = "/root/testdata/sf0.001"
PIECES = [
    "#", "# ", "## a", "###b", "\n", "\n", "\n", "\n\n", " ", "\t", "　", " ", "﻿", "\x85", " ", "|", "a|b", "---", "--- | ---",
    ":-", "```", "```py", "````x", "![[", "]]", "![a](b)", "[[x/y|z]]", "[[ q#r ]]", "word", "longer words here", "é中", "---\n", "\r",
]


def random_notes(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.3:
            text = "---\n" + text
        out.append((f"n{i}", text))
    return out


@pytest.fixture(scope="module")
def both(spark):
    rows = random_notes(11, 1500)
    con = duckdb.connect()
    con.execute("create table notes (note_path varchar, content varchar)")
    con.executemany("insert into notes values (?, ?)", rows)
    return spark.createDataFrame(rows, "note_path string, content string").repartition(8).cache(), con


def compare(df, con, text):
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    assert got == want
    assert got


@pytest.mark.parametrize("size", [7, 20, 60])
def test_random_chunks(both, size):
    df, con = both
    base = (sql.LINES, sql.HEADERS, sql.HEADER_PATHS, sql.SECTIONS, sql.chunk_ctes(size))
    text = sql.with_(*base, recursive=True) + "select * from chunks"
    compare(chunk_notes(df, size), con, text)


def test_random_masks(both):
    df, con = both
    compare(
        df.select("note_path", md.preprocess(F.col("content")).alias("cleaned")),
        con,
        sql.with_(sql.LINES, sql.KINDS, sql.MASKED) + "select * from masked",
    )
    same = df.select(md.preprocess(F.col("content")).alias("m"), "content")
    assert same.filter("size(split(m, '\\n', -1)) <> size(split(content, '\\n', -1))").count() == 0


def test_random_links(both):
    df, con = both
    got = df.select("note_path", F.posexplode(links.wikilink_concepts(F.col("content"))).alias("ord", "concept"))
    compare(got, con, tq.SQL["wikilink_concepts"].replace(sql.with_(sql.NOTES), ""))


def test_parts_never_exceed_the_size(both):
    df, _ = both
    parts = df.select(F.explode(md.greedy_pack(F.col("content"), 12)).alias("p"))
    assert parts.filter(F.length("p") > 12).count() == 0


NAMES = [
    "md_chunks", "preprocess_notes", "slice_spans", "normalize_metadata", "chunk_payload", "read_note_state", "set_concepts",
    "related_by_concept", "dedup_merge_reasons", "vector_topk", "fused_search", "ann_topk", "combine_results", "hot_set",
    "register_batch", "index_upsert", "micro_batch_sink", "paragraph_debounce", "incremental_index", "concept_upsert",
    "ivf_recall", "tiled_search", "bucketed_log", "related_top", "scroll_pages", "index_totals",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_registered_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "events", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    clean = lambda row: repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row))
    assert sorted(df.columns) == sorted(names)
    want = sorted(clean(r) for r in cur.fetchall())
    assert sorted(clean(r) for r in df.select(*names).collect()) == want and want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
