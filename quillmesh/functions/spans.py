"""Model-proposed line spans of a note: parsing, clamping, merging, slicing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.coercion import as_items, as_text, field, is_truthy, kind_of, parse_answer, to_number
from quillmesh.functions.text import let, lines_of, or_else, running_starts, scan, trim_ws

# Fixed value: title of an untitled span.
UNTITLED = "未命名段落"

SPAN = "struct<title:string,start_line:double,end_line:double,header_path:string>"
SLICE = (
    "struct<content:string,start_pos:int,end_pos:int,start_line:int,end_line:int,header_path:string>"
)


def _line_field(item: Column, camel: str, snake: str) -> Column:
    def pick(first: Column) -> Column:
        usable = first.isNotNull() & (kind_of(first) != "VOID")
        return F.when(F.coalesce(usable, F.lit(False)), first).otherwise(field(item, snake))

    return let(field(item, camel), pick)


def parse_spans(answer: Column, total_lines: Column) -> Column:
    """``{"chunks": [...]}`` -> spans sorted by start line, clamped to the note.

    Items without finite line numbers are dropped.  A null item makes the whole
    answer unusable, as does text that is not JSON; both give an empty array.
    """

    def one(item: Column) -> Column:
        title = let(field(item, "title"), lambda t: trim_ws(F.coalesce(F.when(is_truthy(t), as_text(t)), F.lit(""))))
        return F.struct(
            to_number(_line_field(item, "startLine", "start_line")).alias("s"),
            to_number(_line_field(item, "endLine", "end_line")).alias("e"),
            title.alias("t"),
        )

    def clamp(x: Column, i: Column, n: Column) -> Column:
        start = F.greatest(F.lit(1.0), F.least(n, x["s"]))
        return F.struct(
            start.alias("start_line"),
            i.alias("ord"),
            F.greatest(start, F.least(n, x["e"])).alias("end_line"),
            x["t"].alias("t"),
        )

    def build(items: Column, n: Column) -> Column:
        broken = F.exists(items, lambda x: F.coalesce(kind_of(x) == "VOID", F.lit(True)))
        finite = F.filter(F.transform(items, one), lambda x: x["s"].isNotNull() & x["e"].isNotNull())
        ordered = F.array_sort(F.transform(finite, lambda x, i: clamp(x, i, n)))
        shaped = F.transform(
            ordered,
            lambda x: F.struct(
                or_else(x["t"], F.lit(UNTITLED)).alias("title"),
                x["start_line"].alias("start_line"),
                x["end_line"].alias("end_line"),
                x["t"].alias("header_path"),
            ),
        )
        return F.when(broken, F.array().cast(f"array<{SPAN}>")).otherwise(shaped.cast(f"array<{SPAN}>"))

    return let(
        total_lines.cast("double"),
        lambda n: let(as_items(field(parse_answer(answer), "chunks")), lambda items: build(items, n)),
    )


def merge_spans(spans: Column) -> Column:
    """Merge each span into the previous one while they overlap.

    Touching spans stay apart; the first title and header path are kept.
    Input must be sorted by start line.
    """

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        overlaps = F.coalesce(x["start_line"] <= last["end_line"], F.lit(False))
        grown = F.struct(
            last["title"].alias("title"),
            last["start_line"].alias("start_line"),
            F.greatest(last["end_line"], x["end_line"]).alias("end_line"),
            last["header_path"].alias("header_path"),
        ).cast(SPAN)
        closed = F.when(overlaps | last.isNull(), none).otherwise(F.array(last))
        return F.when(overlaps, grown).otherwise(x), closed

    none = F.array().cast(f"array<{SPAN}>")
    return scan(spans, F.lit(None).cast(SPAN), SPAN, step, lambda last: F.when(last.isNull(), none).otherwise(F.array(last)))


def spans_from_chunks(chunk_array: Column) -> Column:
    """Rule-based chunks as spans (used when the model gave nothing usable)."""
    return F.transform(
        chunk_array,
        lambda c: F.struct(
            or_else(c["header_path"], F.lit(UNTITLED)).alias("title"),
            c["start_line"].cast("double").alias("start_line"),
            c["end_line"].cast("double").alias("end_line"),
            c["header_path"].alias("header_path"),
        ),
    ).cast(f"array<{SPAN}>")


def slice_spans(content: Column, spans: Column) -> Column:
    """Cut the spans out of the original text, by line, with true offsets."""

    def cut(lines: Column, starts: Column) -> Column:
        n = F.size(lines).cast("double")

        def one(x: Column) -> Column:
            start = F.greatest(F.lit(1.0), F.least(n, x["start_line"]))
            end = F.greatest(start, F.least(n, x["end_line"]))
            first, last = F.floor(start).cast("int"), F.floor(end).cast("int")
            body = F.array_join(F.slice(lines, first, last - first + 1), "\n")
            pos = F.get(starts, first - 1)
            return F.struct(
                body.alias("content"),
                pos.alias("start_pos"),
                (pos + F.length(body)).alias("end_pos"),
                first.alias("start_line"),
                last.alias("end_line"),
                or_else(x["header_path"], x["title"], F.lit("")).alias("header_path"),
            )

        return F.transform(spans, one)

    return let(lines_of(content), lambda ls: let(line_starts(ls), lambda st: cut(ls, st)))


def line_starts(lines: Column) -> Column:
    """Character offset at which every line begins."""
    return running_starts(F.transform(lines, lambda x: F.length(x) + 1))
