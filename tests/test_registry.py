"""Batch registration against a one-by-one fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import registry as reg

NOW = F.lit("2024-02-01 00:00:00").cast("timestamp")


def fold(incoming, registry):
    """Take the items one by one: strict over everything known, else loose in the
    snapshot, else a new concept."""
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v
    names = [r["concept"] for r in registry]
    cv = np.array([unit(r["concept_vec"]) for r in registry])
    sv = np.array([unit(r["concept_summary_vec"]) for r in registry])
    made, out = [], {}
    for item in sorted(incoming, key=lambda x: x["ord"]):
        v, z = unit(np.array(item["name_vec"])), unit(np.array(item["reason_vec"]))
        known = [(round(float(s), 9), (0, n), n) for s, n in zip(cv @ v, names)]
        known += [(round(float(w @ v), 9), (1, o), n) for o, n, w in made]
        score, _, best = min(known, key=lambda x: (-x[0], x[1])) if known else (0, None, None)
        if score >= 0.9:
            out[item["ord"]] = (best, False)
            continue
        top = lambda m, x: min(zip(-np.round(m @ x, 9), names))[1]
        if top(cv, v) == top(sv, z):
            out[item["ord"]] = (top(cv, v), False)
            continue
        made.append((item["ord"], item["name"], v))
        out[item["ord"]] = (item["name"], True)
    return out


def tables(spark, seed, n, spread):
    rng = np.random.default_rng(seed)
    dim = 6
    rows = lambda m: [[float(x) for x in v] for v in m]
    cv, sv = rows(rng.standard_normal((8, dim))), rows(rng.standard_normal((8, dim)))
    registry = [
        {"concept": f"K{i}", "summary": f"s{i}", "link": "l", "note_count": 1, "concept_vec": cv[i], "concept_summary_vec": sv[i]}
        for i in range(8)
    ]
    centres = rng.standard_normal((5, dim))
    incoming = []
    for o in range(n):
        # A third of the batch are near copies of one centre, some exact copies, one is a zero vector.
        c = centres[0] if o % 3 == 0 else centres[o % 5]
        v = c if o % 7 == 0 else c + spread * rng.standard_normal(dim)
        if o == 11:
            v = np.zeros(dim)
        incoming.append({"ord": o, "name": f"N{o}", "reason": f"r{o}", "name_vec": [float(x) for x in v],
                         "reason_vec": [float(x) for x in rng.standard_normal(dim)]})
    return (
        incoming,
        registry,
        spark.createDataFrame(incoming, "ord bigint, name string, reason string, name_vec array<double>, reason_vec array<double>"),
        spark.createDataFrame(
            registry,
            "concept string, summary string, link string, note_count bigint, concept_vec array<double>, concept_summary_vec array<double>",
        ),
    )


@pytest.mark.parametrize("seed,spread,plan", [(1, 0.1, {}), (2, 0.45, {}), (3, 0.3, {"broadcast_rows": 4, "broadcast_items": 2, "query_tile": 20, "item_tile": 15})])
def test_batch_equals_one_by_one(spark, seed, spread, plan):
    incoming, registry, idf, rdf = tables(spark, seed, 60, spread)
    got = {r["ord"]: (r["concept"], r["is_new"]) for r in reg.register_batch(idf, rdf, **plan).collect()}
    assert got == fold(incoming, registry)


def test_many_near_copies_elect_one_leader(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(6)
    rows = [(o, [float(x) for x in base + 1e-3 * rng.standard_normal(6)]) for o in range(3000)]
    df = spark.createDataFrame(rows, "ord bigint, name_vec array<double>")
    assert [r["ord"] for r in reg.elect_leaders(df).collect()] == [0]


def test_loose_match_needs_agreement(spark):
    r = spark.createDataFrame(
        [("A", [1.0, 0.0], [1.0, 0.0]), ("B", [0.0, 1.0], [0.0, 1.0])],
        "concept string, concept_vec array<double>, concept_summary_vec array<double>",
    )
    i = spark.createDataFrame([(1, [0.8, 0.6], [0.9, 0.1]), (2, [0.8, 0.6], [0.1, 0.9])], "ord bigint, name_vec array<double>, reason_vec array<double>")
    assert [(x["ord"], x["concept"], x["score"]) for x in reg.loose_match(i, r).collect()] == [(1, "A", 1.0)]
    assert reg.loose_match(i, r, k=60).count() == 0
    assert reg.loose_match(i, r, min_cosine=0.85).count() == 0


def registry_rows(spark):
    return spark.sql(
        "select 'A' concept, 'old' summary, 'l' link, 3L note_count, timestamp'2024-01-01' first_seen_at, "
        "timestamp'2024-01-01' last_used_at, array(1.0f) concept_vec, array(2.0f) concept_summary_vec"
    )


def test_upsert_keeps_count_first_use_and_vectors(spark):
    up = spark.sql("select * from values ('A','new','k',array(9f),array(9f)),('B','b','kb',array(5f),array(6f)) as t(concept, summary, link, concept_vec, concept_summary_vec)")
    got = {r["concept"]: r for r in reg.upsert_concepts(registry_rows(spark), up, NOW).collect()}
    a, b = got["A"], got["B"]
    assert (a["summary"], a["link"], a["note_count"], a["concept_vec"], str(a["first_seen_at"])[:10], str(a["last_used_at"])[:10]) == (
        "new", "k", 3, [1.0], "2024-01-01", "2024-02-01")
    assert (b["note_count"], b["concept_vec"], str(b["first_seen_at"])[:10]) == (1, [5.0], "2024-02-01")
    kept = reg.upsert_concepts(registry_rows(spark), up, NOW, update_summary=False).filter("concept = 'A'").first()
    assert kept["summary"] == "old"


def test_touch_counts_uses_and_ignores_unknown(spark):
    uses = spark.sql("select * from values ('A'),('A'),('zz') as t(concept)")
    got = reg.touch_concepts(registry_rows(spark), uses, NOW).collect()
    assert [(r["concept"], r["note_count"]) for r in got] == [("A", 5)]


def test_paging(spark):
    r = spark.range(250).selectExpr("format_string('c%03d', id) concept", "array(1f) concept_vec", "array(1f) concept_summary_vec")
    seen, last = [], None
    while True:
        page = [x["concept"] for x in reg.scroll_concepts(r, after=last).collect()]
        if not page:
            break
        seen += page
        last = page[-1]
    assert seen == [f"c{n:03d}" for n in range(250)]
