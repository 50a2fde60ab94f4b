"""Model answers: metadata, concepts, spans, links."""

import json

import pytest
from conftest import one
from pyspark.sql import functions as F

from quillmesh.functions import links
from quillmesh.functions import metadata as meta
from quillmesh.functions import spans as sp
from quillmesh.operators.chunking import resolved_spans

C = F.col("c")


def metadata(spark, answer, content="text"):
    m = one(spark, meta.normalize_metadata(F.col("a"), C), a=answer, c=content)
    return m["summary"], m["tags"], m["category"], [tuple(x) for x in m["concepts"]]


EMPTY = ("", [], "", [])
DEFAULTS = ("", [], "技术笔记", [])


@pytest.mark.parametrize("answer", ["no json", "null", '{"tags":[5]}', '{"tags":[{"a":1}]}', ""])
def test_unusable_answers_give_the_empty_record(spark, answer):
    assert metadata(spark, answer) == EMPTY


@pytest.mark.parametrize("answer", ["{}", "5", "[]", '"x"', '{"summary":0,"tags":"x","category":7,"concepts":{}}'])
def test_answers_without_fields_give_defaults(spark, answer):
    assert metadata(spark, answer) == DEFAULTS


def test_blank_content_gives_the_empty_record(spark):
    assert metadata(spark, '{"summary":"s"}', " \n") == EMPTY


def test_tags_are_distinct_unblank_and_limited(spark):
    answer = json.dumps({"tags": ["a", " ", "a", "b", None, "", 0, " a", "c", "d", "e"]})
    assert metadata(spark, answer)[1] == ["a", "b", " a", "c", "d"]


def test_concept_confidence_coercion(spark):
    items = [
        " A ", {"name": "B"}, {"name": "C", "confidence": None}, {"name": "D", "confidence": " 0.25 "},
        {"name": "E", "confidence": "high"}, {"name": "F", "confidence": 1},
    ]
    got = metadata(spark, json.dumps({"concepts": items}))[3]
    assert got == [("A", 0.7), ("B", 0.7), ("C", 0.0), ("D", 0.25), ("E", 0.7)]


def test_concepts_keep_the_first_of_equal_confidence(spark):
    items = [{"name": "x", "confidence": 0.5}, {"name": "Y", "confidence": 0.9}, {"name": "X", "confidence": 0.5},
             {"name": "y", "confidence": 0.95}, True, {"name": 3}]
    assert metadata(spark, json.dumps({"concepts": items}))[3] == [("x", 0.5), ("y", 0.95)]


def test_concept_reason(spark):
    reason = lambda s, h: one(spark, meta.concept_reason(C, F.col("h")), c=s, h=h)
    assert reason(" s ", "# H") == "s"
    assert reason(" ", "# H") == "片段主题: # H"
    assert reason("", "") == "来自片段内容"


def test_keyword_category_ties_follow_list_order(spark):
    cat = lambda t: one(spark, meta.keyword_category(C), c=t)
    assert cat("zzz") == "技术笔记"
    assert cat("My MOOD today") == "生活日记"
    assert cat("mood, maybe") == "生活日记"
    assert cat("maybe perhaps an idea") == "想法灵感"


def test_truncation(spark):
    assert one(spark, meta.truncate_for_prompt(C, 3), c="abcd") == "abc..."
    assert one(spark, meta.truncate_for_prompt(C, 3), c="abc") == "abc"


def spans(spark, items, n=10):
    text = json.dumps({"chunks": items}) if not isinstance(items, str) else items
    return [(s["title"], s["start_line"], s["end_line"], s["header_path"]) for s in one(spark, sp.parse_spans(C, F.lit(n)), c=text)]


def test_span_coercion_and_clamping(spark):
    got = spans(
        spark,
        [
            {"title": " A ", "startLine": "3", "endLine": 5},
            {"title": None, "startLine": None, "start_line": 1, "endLine": None, "end_line": 2},
            {"title": "rev", "startLine": 9, "endLine": 7},
            {"title": "far", "startLine": 0, "endLine": 99},
            {"title": "none", "startLine": 2},
            {"title": "word", "startLine": "x", "endLine": 3},
            {"title": 7, "startLine": True, "endLine": ""},
        ],
    )
    assert got == [
        ("未命名段落", 1.0, 2.0, ""), ("far", 1.0, 10.0, "far"), ("7", 1.0, 1.0, "7"), ("A", 3.0, 5.0, "A"),
        ("rev", 9.0, 9.0, "rev"),
    ]


@pytest.mark.parametrize("answer", ["{}", "nope", '{"chunks":5}', '{"chunks":[null]}', '{"chunks":[]}'])
def test_useless_span_answers(spark, answer):
    assert spans(spark, answer) == []
    rows = one(spark, resolved_spans(F.col("a"), C, 100), a=answer, c="# H\nx\n# G\ny")
    assert [(r["title"], r["start_line"], r["end_line"]) for r in rows] == [("# H", 1.0, 3.0), ("# G", 3.0, 4.0)]


def test_touching_spans_stay_apart_and_overlaps_merge(spark):
    text = json.dumps({"chunks": [{"title": t, "startLine": a, "endLine": b} for t, a, b in
                                  [("a", 1, 3), ("b", 3, 4), ("c", 5, 6), ("d", 5, 9), ("e", 8, 8)]]})
    merged = one(spark, sp.merge_spans(sp.parse_spans(C, F.lit(10))), c=text)
    assert [(s["title"], s["start_line"], s["end_line"]) for s in merged] == [("a", 1.0, 4.0), ("c", 5.0, 9.0)]


def test_slices_use_true_offsets(spark):
    text = json.dumps({"chunks": [{"title": "x", "startLine": 2, "endLine": 3}, {"startLine": 4, "endLine": 4}]})
    got = one(spark, sp.slice_spans(C, sp.parse_spans(F.col("a"), F.lit(4))), c="aa\nbb\n\ndd", a=text)
    assert [(s["content"], s["start_pos"], s["end_pos"], s["header_path"]) for s in got] == [
        ("bb\n", 3, 6, "x"), ("dd", 7, 9, "未命名段落"),
    ]


def test_wikilinks(spark):
    text = "[[a/b/C|al]] [[ |x]] [[D#h]] [[/]] [[C]] [[E/ ]] [[#only]] [[ F /G ]] [[x\ny]]"
    assert one(spark, links.wikilink_concepts(C), c=text) == ["C", "D", "/", "E", "G", "x\ny"]


def test_merge_links(spark):
    merged = one(spark, links.merge_links(F.array(F.lit("[[X]]"), F.lit("[[p/q/Y]]"), F.lit("[[_me/Y]]")), F.array(F.lit("N"), F.lit("Y"))))
    assert merged == ["[[_me/[[X]]]]", "[[_me/Y]]", "[[_me/N]]"]
