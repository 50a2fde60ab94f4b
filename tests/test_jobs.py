"""Index store, hot set, embedding adapter, note state, sources and jobs."""

import random

import pytest
from conftest import one
from pyspark.sql import functions as F

from quillmesh.operators import concepts as con
from quillmesh.operators import notes as state
from quillmesh.operators.embedding import embed_columns, embed_texts, split_results
from quillmesh.functions.coercion import to_number
from quillmesh.operators.hotset import hot_set
from quillmesh.plans import indexing, review
from quillmesh.session import discard, materialize, path_exists, shared_dir
from quillmesh.sources import index_store as store
from quillmesh.sources.notes import read_vault


def index(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, file_path string, content string")


def ids(df):
    return sorted((r["chunk_id"], r["content"]) for r in df.collect())


def test_upsert_is_idempotent_and_last_write_wins(spark):
    base = index(spark, [("a", "f", "1"), ("b", "f", "1")])
    new = index(spark, [("b", "f", "2"), ("c", "g", "2")])
    once = store.upsert(base, new)
    assert ids(once) == [("a", "1"), ("b", "2"), ("c", "2")]
    assert ids(store.upsert(once, new)) == ids(once)


def test_tombstones_and_later_versions(spark):
    base = index(spark, [("a", "f", "1"), ("b", "f", "1")])
    log = (
        store.as_upserts(base, F.lit(0))
        .unionByName(store.as_tombstones(base, base.filter("chunk_id = 'a'"), F.lit(1)))
        .unionByName(store.as_tombstones(base, base.filter("chunk_id = 'b'"), F.lit(1)))
        .unionByName(store.as_upserts(index(spark, [("b", "f", "3")]), F.lit(2)))
    )
    assert ids(store.current_view(log)) == [("b", "3")]


def test_reindexing_removes_stale_chunks(spark):
    base = index(spark, [("f-0", "f", "1"), ("f-1", "f", "1"), ("g-0", "g", "1")])
    assert ids(store.replace_files(base, index(spark, [("f-0", "f", "2")]))) == [("f-0", "2"), ("g-0", "1")]


def test_save_flushes_the_whole_queue_or_nothing(spark):
    pending = index(spark, [("a", "f", "1"), ("b", "g", "1")])
    assert store.flush_on_save(pending, "f").count() == 2
    assert store.flush_on_save(pending, "zz").count() == 0
    assert store.cleared(pending).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_hot_set_equals_running_sum(spark, seed):
    rng = random.Random(seed)
    access = rng.sample(range(10**9), 400)
    rows = [(f"c{i}", a, "x" * rng.randint(0, 900), [1.0] * 3, "{}") for i, a in enumerate(access)]
    df = spark.createDataFrame(rows, "chunk_id string, last_access bigint, content string, embedding array<double>, metadata string")
    for budget in (10, 5_000, 100_000, 10**9):
        want, used = set(), 0
        for cid, _, text, _, _ in sorted(rows, key=lambda r: -r[1]):
            used += 2 * len(text) + 24 + 4 + 100
            if want and used > budget:
                break
            want.add(cid)
        assert {r["chunk_id"] for r in hot_set(df, budget).collect()} == want
    assert hot_set(df.limit(0)).count() == 0


def test_embedding_errors_are_reported_by_row(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no vector")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "aa"), (2, "bad"), (3, "aa"), (4, None)], "id int, text string")
    good, bad = split_results(embed_texts(df, embed, continue_on_error=True))
    assert sorted((r["id"], r["vec"]) for r in good.collect()) == [(1, [2.0]), (3, [2.0]), (4, None)]
    assert [(r["id"], r["error"]) for r in bad.collect()] == [(2, "no vector")]
    with pytest.raises(Exception, match="no vector"):
        embed_texts(df, embed).collect()


def test_repeated_texts_are_embedded_once_per_batch(spark):
    def embed(texts):
        assert len(set(texts)) == len(texts)
        return [[1.0] for _ in texts]

    df = spark.createDataFrame([("t", "t"), ("t", "u")], "a string, b string").coalesce(1)
    assert embed_columns(df, embed, {"a": "va", "b": "vb"}).count() == 2


def test_reindex_rules(spark):
    df = spark.sql(
        "select * from values (null), (''), ('bad'), ('2024-01-15T00:00:00.000Z'), ('2024-01-14T23:59:59.999Z') as t(me_indexed_at)"
    ).withColumn("mtime", F.lit("2024-01-15 00:00:00Z").cast("timestamp"))
    assert [r[0] for r in df.select(state.needs_reindex()).collect()] == [True, True, False, False, True]


def states(spark):
    return spark.createDataFrame(
        [("a", None, None), ("b", [], None), ("c", ["[[_me/X]]", "[[Y]]"], "t"), ("d", None, "")],
        "note_path string, me_concepts array<string>, me_indexed_at string",
    )


def test_clearing_keeps_notes_without_state(spark):
    got = {r["note_path"]: r["cleared"] for r in state.clear_fields(states(spark)).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False}


def test_new_names_merge_and_empty_list_differs_by_operator(spark):
    rows = spark.createDataFrame([("c", 0, "X"), ("c", 1, "N"), ("c", 2, "N")], "note_path string, ord int, name string")
    joined = states(spark).join(state.new_names(rows), "note_path", "left")
    kept = {r["note_path"]: r["me_concepts"] for r in state.set_concepts(joined).collect()}
    assert kept == {"a": None, "b": [], "c": ["[[_me/X]]", "[[_me/[[Y]]]]", "[[_me/N]]"], "d": None}
    rewritten = {r["note_path"]: r["me_concepts"] for r in state.update_after_indexing(joined, F.lit("now")).collect()}
    assert rewritten["a"] == [] and rewritten["c"] == kept["c"]


def test_reading_state_from_frontmatter(spark):
    texts = [
        '---\nme_concepts:\n  - "[[_me/A]]"\n  - \'[[_me/B c]]\'\nme_indexed_at: 2024-01-01T00:00:00.000Z\n---\nx',
        '---\nme_concepts: ["[[_me/A]]", b]\n---\n',
        "---\nme_concepts: []\n---\n",
        "---\nother: 1\n---\nme_indexed_at: no",
        "---\nme_indexed_at: x\nunclosed",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "note_path int, content string")
    got = [(r[1], r[2]) for r in state.read_state(df).orderBy("note_path").collect()]
    assert got == [
        (["[[_me/A]]", "[[_me/B c]]"], "2024-01-01T00:00:00.000Z"), (["[[_me/A]]", "b"], None), ([], None),
        (None, None), (None, None),
    ]


def mentions(spark, rows):
    return spark.createDataFrame([("n", o, *r) for o, r in enumerate(rows)], "note_path string, ord int, name string, confidence double, reason string")


def test_reason_merge_is_a_left_fold(spark):
    m = mentions(spark, [(" X", 0.5, "a"), ("x ", 0.5, " b "), ("X", 0.9, "a"), ("y", 0.1, None)])
    got = {r["name"]: (r["confidence"], r["reason"]) for r in con.dedup_merge_reasons(m).collect()}
    assert got == {"X": (0.9, "a; b; a"), "y": (0.1, None)}
    flat = {r["name"]: r["reason"] for r in con.dedup_merge_reasons(m, flat_reasons=True).collect()}
    assert flat["X"] == "a; b"


def test_dedup_keeps_first_of_equal_confidence(spark):
    m = mentions(spark, [("A", 0.5, "1"), ("b", 0.2, "2"), ("a", 0.5, "3"), ("B", 0.3, "4")])
    got = sorted((r["first_ord"], r["name"], r["reason"]) for r in con.dedup_concepts(m).collect())
    assert got == [(0, "A", "1"), (1, "B", "4")]


def test_filter_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        con.filter_concepts(mentions(spark, [("A", 0.5, "1")]), max_concepts=21)


def test_related_notes_broadcast_and_salted_plans_agree(spark, monkeypatch):
    rows = [(f"n{i:02d}", [f"l{i % 3}", "hot", f"l{i % 3}"] if i % 4 else ["hot"]) for i in range(30)] + [("z", None), ("e", [])]
    df = spark.createDataFrame(rows, "note_path string, me_concepts array<string>")
    want = sorted(map(tuple, con.related_by_concept(df, df).select("target_path", "note_path", F.array_join("shared", ","), "rank").collect()))
    monkeypatch.setattr(con, "BROADCAST_TARGETS", 1)
    got = sorted(map(tuple, con.related_by_concept(df, df).select("target_path", "note_path", F.array_join("shared", ","), "rank").collect()))
    assert got == want and len(got) == 30 * 29
    assert ("n01", "n05", "hot", 0) not in got
    assert [r for r in got if r[:2] == ("n01", "n07")][0][2] == "l1,hot,l1"


def test_vault_reader(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a b.md").write_text("# A\nline\n", encoding="utf-8")
    (tmp_path / "c.md").write_bytes(b"x\xff")
    (tmp_path / "d.txt").write_text("no", encoding="utf-8")
    (tmp_path / "sub dir" / "empty.md").write_text("", encoding="utf-8")
    got = {r["note_path"]: (r["title"], r["content"]) for r in read_vault(spark, str(tmp_path)).collect()}
    assert got["sub dir/a b.md"] == ("a b", "# A\nline\n")
    assert got["c.md"] == ("c", "x\ufffd") and len(got) == 3
    assert got["sub dir/empty.md"] == ("empty", "")


def test_indexing_jobs(spark):
    embedder = lambda texts: [[float(len(t)), 1.0] for t in texts]
    notes = spark.createDataFrame(
        [("n.md", "# A\nalpha\n# B\nbeta"), ("e.md", " \n")], "note_path string, content string"
    )
    answer = '{"summary":"S","tags":["t"],"category":"读书笔记","concepts":[{"name":"C","confidence":0.4},"c"]}'
    answers = spark.createDataFrame([("n.md", 0, answer), ("n.md", 1, "oops")], "note_path string, index int, response string")
    out = indexing.index_notes(notes, answers, embedder, F.lit(5))
    rows = {r["chunk_id"]: r for r in out.rows.collect()}
    assert set(rows) == {"n.md-chunk-0", "n.md-chunk-1"}
    first, second = rows["n.md-chunk-0"], rows["n.md-chunk-1"]
    assert (first["tags"], first["concepts"], first["word_count"], first["summary_vec"]) == (["t", "读书笔记"], ["c"], 10, [1.0, 1.0])
    assert (second["tags"], second["summary"], second["summary_vec"], second["title_vec"]) == ([], "", [8.0, 1.0], [3.0, 1.0])
    assert [(r["name"], r["confidence"], r["reason"]) for r in out.concepts.collect()] == [("c", 0.7, "S")]
    spans = spark.createDataFrame([("n.md", '{"chunks":[{"title":"all","startLine":1,"endLine":4}]}')], "note_path string, response string")
    unified = indexing.unified_index(notes, spans, answers, embedder, F.lit(5)).rows.collect()
    assert [(r["header_path"], r["start_line"], r["end_line"]) for r in unified] == [("all", 1, 4)]


def test_propose_and_apply(spark):
    registry = spark.sql(
        "select 'Known' concept, 's' summary, '[[_me/Known]]' link, 1L note_count, timestamp'2024-01-01' first_seen_at, "
        "timestamp'2024-01-01' last_used_at, array(1f, 0f) concept_vec, array(1f, 0f) concept_summary_vec"
    )
    rows = [
        (0, "a.md", "known-ish", 0.5, "r0", [1.0, 0.1], [0.0, 1.0]),
        (1, "a.md", "Fresh", 0.6, "r1", [-1.0, 1.0], [0.0, 1.0]),
        (2, "b.md", "fresh 2", 0.7, "r2", [-1.0, 1.05], [0.0, 1.0]),
    ]
    incoming = spark.createDataFrame(
        rows, "ord bigint, note_path string, name string, confidence double, reason string, name_vec array<double>, reason_vec array<double>"
    )
    proposed = review.propose(incoming, registry, loose=None)
    got = sorted((r["note_path"], r["name"], r["match_info"]["match_type"]) for r in proposed.collect())
    assert got == [("a.md", "Fresh", "new"), ("a.md", "Known", "alias"), ("b.md", "Fresh", "alias")]
    selected = proposed.withColumnRenamed("first_ord", "ord").join(incoming.select("ord", "name_vec", "reason_vec"), "ord")
    notes = spark.createDataFrame([("a.md", None, None), ("b.md", ["[[_me/Old]]"], None), ("c.md", None, "old")],
                                  "note_path string, me_concepts array<string>, me_indexed_at string")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    applied = review.apply_concepts(selected, registry, notes, now, F.lit("T"), loose=None)
    assert {r["note_path"]: (r["me_concepts"], r["me_indexed_at"]) for r in applied.note_state.collect()} == {
        "a.md": (["[[_me/Known]]", "[[_me/Fresh]]"], "T"),
        "b.md": (["[[_me/Old]]", "[[_me/Fresh]]"], "T"),
        "c.md": (None, "old"),
    }
    assert sorted(map(tuple, applied.aliases.collect())) == [("fresh 2", "Fresh"), ("known-ish", "Known")]
    assert {r["concept"]: r["note_count"] for r in applied.usage.collect()} == {"Known": 1, "Fresh": 2}
    stored = {r["concept"]: (r["note_count"], r["last_used_at"].isoformat()) for r in applied.registry.collect()}
    assert {k: n for k, (n, _) in stored.items()} == {"Fresh": 2, "Known": 2}
    assert len({at for _, at in stored.values()}) == 1 and "2024-02-01" in stored["Known"][1]


def test_a_failing_text_fails_its_note_only(spark):
    def embedder(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    notes = spark.createDataFrame([("good.md", "# A\nalpha"), ("half.md", "# A\nfine\n# B\nbad one")], "note_path string, content string")
    answers = spark.createDataFrame(
        [(n, i, '{"concepts":["c"]}') for n in ("good.md", "half.md") for i in (0, 1)], "note_path string, index int, response string"
    )
    out = indexing.index_notes(notes, answers, embedder, F.lit(5))
    assert {r["file_path"] for r in out.rows.collect()} == {"good.md"}
    assert {r["note_path"] for r in out.concepts.collect()} == {"good.md"}
    assert [tuple(r) for r in out.failed.collect()] == [("half.md", "refused", 1)]


def test_a_blanked_note_loses_its_chunks(spark):
    index = spark.createDataFrame([("a-0", "a.md", "old"), ("b-0", "b.md", "old")], "chunk_id string, file_path string, content string")
    rows = index.limit(0)
    stale = spark.createDataFrame([("a.md", " ")], "note_path string, content string")
    assert [r["chunk_id"] for r in indexing.refresh_index(index, rows, stale).collect()] == ["b-0"]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session)


def test_discarded_tables_are_gone(spark):
    df = materialize(spark.range(3), "probe")
    discard(df)
    assert not path_exists(spark, df.stored_at)


def test_numbers_of_answers(spark):
    values = {"[]": 0.0, '["3"]': 3.0, '"0x10"': 16.0, '"0b11"': 3.0, "[1,2]": None, '"x"': None, "[[4]]": None, "[null]": 0.0, '" 7 "': 7.0, "true": 1.0}
    got = {v: one(spark, to_number(F.parse_json(F.col("c"))), c=v) for v in values}
    assert got == values


def test_related_notes_with_a_limit(spark):
    rows = [(f"n{i:02d}", ["hot", f"l{i % 3}"]) for i in range(30)]
    df = spark.createDataFrame(rows, "note_path string, me_concepts array<string>")
    full = con.related_by_concept(df, df).select("target_path", "note_path", "rank")
    few = con.related_by_concept(df, df, limit=4).select("target_path", "note_path", "rank")
    assert sorted(few.collect()) == sorted(full.where("rank <= 4").collect())


def test_intermediate_tables_live_in_the_shared_folder(spark):
    df = materialize(spark.range(3), "probe")
    assert shared_dir(spark).rstrip("/") in df.inputFiles()[0]
    assert one(spark, F.lit(1)) == 1
