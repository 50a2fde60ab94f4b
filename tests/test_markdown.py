"""Hand-written goldens of the markdown functions."""

import pytest
from conftest import one
from pyspark.sql import functions as F

from quillmesh.functions import markdown as md
from quillmesh.functions.text import percent_badge, trim_ws

C = F.col("c")


def headers(spark, text):
    return [tuple(h)[:3] for h in one(spark, md.headers(C), c=text)]


def test_header_forms(spark):
    text = "#tag\n  ## two \n#\n####### deep\nno # here\n\t#　x"
    assert headers(spark, text) == [(1, "tag", 0), (2, "two", 5), (7, "deep", 17), (1, "x", 40)]


def test_header_inside_fence_counts(spark):
    assert headers(spark, "```\n# in\n```") == [(1, "in", 4)]


def test_header_path_pops_siblings_and_deeper(spark):
    text = "# A\n### B\n## C\n### D\n# E"
    paths = one(spark, F.transform(md.header_paths(md.headers(C)), md.header_path_text), c=text)
    assert paths == ["# A", "# A > ### B", "# A > ## C", "# A > ## C > ### D", "# E"]


def test_sections_drop_preamble_and_overlap_line_numbers(spark):
    rows = [s.asDict() for s in one(spark, md.sections(C), c="pre\n# A\nx\n# B\ny")]
    assert [(r["content"], r["start_pos"], r["end_pos"], r["start_line"], r["end_line"]) for r in rows] == [
        ("# A\nx\n", 4, 10, 2, 4),
        ("# B\ny", 10, 15, 4, 5),
    ]


def test_line_number(spark):
    assert [one(spark, md.line_number_at(C, F.lit(p)), c="a\nb\nc") for p in (0, 1, 2, 4, 99)] == [1, 1, 2, 3, 3]


@pytest.mark.parametrize(
    "text,size,parts",
    [
        ("short", 5, ["short"]),
        ("abcde\nfg", 5, ["abcde", "fg"]),  # a line of exactly the size stays whole
        ("abcdef\ng", 5, ["abcde", "f", "g"]),  # one more is sliced
        ("ab\ncd\nef", 6, ["ab\ncd", "ef"]),
        ("ab\ncd\ne", 5, ["ab", "cd\ne"]),  # the line break of the last line is charged
        ("\n\n\n\n\nabcdefghi", 5, ["", "abcde", "fghi"]),  # white part is kept, empty
        ("ab \n　\nabcde", 6, ["ab", "abcde"]),
    ],
)
def test_greedy_pack(spark, text, size, parts):
    assert one(spark, md.greedy_pack(C, size), c=text) == parts


def test_split_long_line(spark):
    assert one(spark, md.split_long_line(C, 3), c="abcdefg") == ["abc", "def", "g"]
    assert one(spark, md.split_long_line(C, 3), c="abcdef") == ["abc", "def"]


def chunk_tuples(spark, text, size):
    return [
        (c["content"], c["header_path"], c["start_pos"], c["end_pos"], c["start_line"], c["end_line"])
        for c in one(spark, md.chunks(C, size), c=text)
    ]


def test_chunks_without_headers(spark):
    assert chunk_tuples(spark, "a\nb", 10) == [("a\nb", "", 0, 3, 1, 2)]


def test_blank_note_has_no_chunks(spark):
    assert chunk_tuples(spark, " \n\t﻿\n", 10) == []


def test_chunk_offsets_drift_behind_trimmed_text(spark):
    got = chunk_tuples(spark, "# H\naaa\n\n\nbbb\nccc", 9)
    assert got == [
        ("# H\naaa", "# H", 0, 7, 1, 2),
        ("\nbbb\nccc", "# H", 7, 15, 2, 6),  # true offsets would be 9 to 17
    ]


def masked(spark, text):
    return one(spark, md.preprocess(C), c=text).split("\n")


def test_preprocess_kinds(spark):
    text = "---\nt: 1\n---\nhi\n```py x\n![[a]]\n```\n![[b]]\n![x](y)\na|b\n---|---\nc|d\nend"
    assert masked(spark, text) == [
        "[frontmatter]", "[frontmatter]", "[frontmatter]", "hi", "[code block start: py x]", "[code line]",
        "[code block end]", "[image]", "[image]", "[table row]", "[table row]", "[table row]", "end",
    ]


def test_unclosed_frontmatter_and_fence(spark):
    assert masked(spark, "---\na\nb") == ["---", "a", "b"]
    assert masked(spark, "x\n```\n# y\n") == ["x", "[code block start: text]", "[code line]", "[code line]"]


def test_table_survives_fence_and_image(spark):
    text = "a|b\n---\n|c\n```\nq\n```\nd|e\n![[i]]\nf|g\nstop\nh|i"
    assert masked(spark, text) == [
        "[table row]", "---", "|c", "[code block start: text]", "[code line]", "[code block end]", "d|e", "[image]",
        "f|g", "stop", "h|i",
    ]
    text = "a|b\n-|-\n```\nq\n```\nd|e\n![[i]]\nf|g\nstop\nh|i"
    assert masked(spark, text) == [
        "[table row]", "[table row]", "[code block start: text]", "[code line]", "[code block end]", "[table row]",
        "[image]", "[table row]", "stop", "h|i",
    ]


def test_separator_without_pipe_starts_a_table(spark):
    assert masked(spark, "a|b\n--- \nz") == ["[table row]", "--- ", "z"]


def test_add_line_numbers(spark):
    assert one(spark, md.add_line_numbers(C), c="\n".join("abcdefghij")).split("\n")[8:] == ["09: i", "10: j"]


def test_trim_keeps_next_line_character(spark):
    assert one(spark, trim_ws(C), c="  \x85x ﻿\n") == "\x85x"


def test_badge_rounds_half_up(spark):
    assert [one(spark, percent_badge(C), c=x) for x in (0.125, 0.994, 0.995, 1.0)] == [13, 99, 100, 100]
