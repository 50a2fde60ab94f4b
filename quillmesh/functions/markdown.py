"""Markdown structure as column expressions over one note per row.

Everything here is evaluated inside the projection that reads the note, with
higher-order functions over its line array: no explode, no shuffle, no window,
so the corpus is processed at scan speed and a huge source or folder cannot
become a hot partition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import (
    SPACE,
    is_blank,
    let,
    lines_of,
    ltrim_ws,
    pieces_of,
    rtrim_ws,
    running_starts,
    scan,
    trim_ws,
)

DEFAULT_MAX_CHARS = 800

HEADER = "struct<level:int,header_text:string,position:int,line_no:int>"
PATH_STEP = "array<struct<level:int,text:string>>"
SECTION = (
    f"struct<content:string,path:{PATH_STEP},header_path:string,"
    "start_pos:int,end_pos:int,start_line:int,end_line:int>"
)

# Patterns and masks of the preprocessing format.
SEPARATOR_LINE = (
    rf"^[{SPACE}]*\|?[{SPACE}]*[:\- ]+\|?[{SPACE}]*(\|[{SPACE}]*[:\- ]+[{SPACE}]*)*\|?[{SPACE}]*\z"
)
IMAGE_LINK = r"!\[[^\]]*\]\([^\)]+\)"
FENCE = "```"
MASK_FRONTMATTER = "[frontmatter]"
MASK_CODE_START = "[code block start: "
MASK_CODE_END = "[code block end]"
MASK_CODE_LINE = "[code line]"
MASK_IMAGE = "[image]"
MASK_TABLE = "[table row]"


def _empty(sql_type: str) -> Column:
    return F.array().cast(sql_type)


# ---------------------------------------------------------------- headers


def _headers_of_lines(lines: Column) -> Column:
    def step(at: Column, line: Column) -> tuple[Column, Column]:
        def with_header(t: Column) -> Column:
            rest = F.ltrim(t, F.lit("#"))
            text = trim_ws(rest)
            found = F.struct(
                (F.length(t) - F.length(rest)).alias("level"),
                text.alias("header_text"),
                at["pos"].alias("position"),
                at["line_no"].alias("line_no"),
            )
            hit = F.startswith(t, F.lit("#")) & (text != "")
            return F.when(hit, F.array(found)).otherwise(_empty(f"array<{HEADER}>"))

        after = F.struct((at["pos"] + F.length(line) + 1).alias("pos"), (at["line_no"] + 1).alias("line_no"))
        return after, let(ltrim_ws(line), with_header)

    return scan(lines, F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line_no")), HEADER, step)


def headers(content: Column) -> Column:
    """Header lines with level, trimmed text, character offset and 1-based line."""
    return _headers_of_lines(lines_of(content))


def header_paths(header_array: Column) -> Column:
    """For each header, its ancestors and itself (levels strictly increasing)."""

    def step(stack: Column, h: Column) -> tuple[Column, Column]:
        me = F.struct(h["level"].alias("level"), h["header_text"].alias("text"))
        now = F.concat(F.filter(stack, lambda a: a["level"] < h["level"]), F.array(me))
        return now, F.array(now)

    return scan(header_array, _empty(PATH_STEP), PATH_STEP, step)


def header_path_text(path: Column) -> Column:
    """``# H1 > ## H2``; empty string when the path is empty."""
    return F.array_join(
        F.transform(path, lambda h: F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["text"])),
        " > ",
    )


def line_number_at(content: Column, position: Column) -> Column:
    """1-based line holding character offset ``position``."""
    return F.size(lines_of(F.substring(content, F.lit(1), position)))


# ---------------------------------------------------------------- sections


def _sections(content: Column, lines: Column, hs: Column) -> Column:
    n_lines = F.size(lines)

    def with_paths(paths: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            nxt = F.get(hs, i + 1)
            last = nxt.isNull()
            after = F.when(last, n_lines + 1).otherwise(nxt["line_no"])
            body = F.array_join(F.slice(lines, h["line_no"], after - h["line_no"]), "\n")
            path = F.get(paths, i)
            return F.struct(
                F.when(last, body).otherwise(F.concat(body, F.lit("\n"))).alias("content"),
                path.alias("path"),
                header_path_text(path).alias("header_path"),
                h["position"].alias("start_pos"),
                F.when(last, F.length(content)).otherwise(nxt["position"]).alias("end_pos"),
                h["line_no"].alias("start_line"),
                F.when(last, n_lines).otherwise(nxt["line_no"]).alias("end_line"),
            )

        return F.transform(hs, one)

    return let(header_paths(hs), with_paths)


def sections(content: Column) -> Column:
    """One section per header; text before the first header belongs to none."""
    return let(
        content,
        lambda c: let(lines_of(c), lambda ls: let(_headers_of_lines(ls), lambda hs: _sections(c, ls, hs))),
    )


def _sections_or_whole(content: Column) -> Column:
    def pick(c: Column, ls: Column, hs: Column) -> Column:
        whole = F.array(
            F.struct(
                c.alias("content"),
                _empty(PATH_STEP).alias("path"),
                F.lit("").alias("header_path"),
                F.lit(0).alias("start_pos"),
                F.length(c).alias("end_pos"),
                F.lit(1).alias("start_line"),
                F.size(ls).alias("end_line"),
            )
        )
        return F.when(F.size(hs) == 0, whole).otherwise(_sections(c, ls, hs))

    return let(
        content,
        lambda c: let(lines_of(c), lambda ls: let(_headers_of_lines(ls), lambda hs: pick(c, ls, hs))),
    )


# ---------------------------------------------------------------- packing


def split_long_line(line: Column, max_chars: int) -> Column:
    """Fixed-width slices of ``max_chars``; the remainder comes last."""
    return pieces_of(line, max_chars)


def greedy_pack(text: Column, max_chars: int) -> Column:
    """Pack whole lines into parts of at most ``max_chars`` characters.

    A text that already fits is returned as it is.  Every line is charged one
    extra character for its line break, the last one too.  Longer lines are
    sliced and never share a part with their neighbours.
    """
    limit = F.lit(max_chars)
    none = _empty("array<string>")

    def close(cur: Column) -> Column:
        return F.when(cur != "", F.array(rtrim_ws(cur))).otherwise(none)

    def step(cur: Column, line: Column) -> tuple[Column, Column]:
        fits = F.length(cur) + F.length(line) + 1 <= limit
        too_long = F.length(line) > limit
        with_break = F.concat(line, F.lit("\n"))
        parts = (
            F.when(fits, none)
            .when(too_long, F.concat(close(cur), split_long_line(line, max_chars)))
            .otherwise(close(cur))
        )
        return F.when(fits, F.concat(cur, with_break)).when(too_long, F.lit("")).otherwise(with_break), parts

    packed = scan(lines_of(text), F.lit(""), "string", step, close)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def _locate_parts(section: Column, parts: Column) -> Column:
    """Chunks of one oversized section.

    Offsets advance by the length of the *trimmed* parts, so they fall behind
    the text by the whitespace dropped between parts; the line numbers follow
    those offsets.
    """
    content = section["content"]

    def breaks_before(starts: Column, ends: Column) -> Column:
        """For each end, the line breaks before it: breaks and ends in one order, counted in one pass."""
        events = F.array_sort(
            F.concat(
                F.transform(F.filter(starts, lambda p: p > 0), lambda p: F.struct((p - 1).alias("at"), F.lit(1).alias("is_break"))),
                F.transform(ends, lambda e: F.struct(e.alias("at"), F.lit(0).alias("is_break"))),
            )
        )
        return scan(
            events,
            F.lit(0),
            "int",
            lambda n, e: (n + e["is_break"], F.when(e["is_break"] == 0, F.array(n)).otherwise(_empty("array<int>"))),
        )

    def located(ends: Column, breaks: Column) -> Column:
        before = lambda values, i: F.coalesce(F.get(values, i - 1), F.lit(0))
        return F.transform(
            parts,
            lambda part, i: F.struct(
                part.alias("content"),
                section["path"].alias("path"),
                section["header_path"].alias("header_path"),
                (section["start_pos"] + before(ends, i)).alias("start_pos"),
                (section["start_pos"] + F.get(ends, i)).alias("end_pos"),
                (section["start_line"] + before(breaks, i)).alias("start_line"),
                (section["start_line"] + F.get(breaks, i)).alias("end_line"),
            ),
        )

    ends = scan(parts, F.lit(0), "int", lambda at, part: (at + F.length(part), F.array(at + F.length(part))))
    starts = running_starts(F.transform(lines_of(content), lambda x: F.length(x) + 1))
    return let(ends, lambda e: let(breaks_before(starts, e), lambda b: located(e, b)))


def chunks(content: Column, max_chars: int = DEFAULT_MAX_CHARS) -> Column:
    """Rule-based chunks of a note, in reading order; empty for a blank note."""

    def refine(section: Column) -> Column:
        return F.when(F.length(section["content"]) <= F.lit(max_chars), F.array(section)).otherwise(
            let(greedy_pack(section["content"], max_chars), lambda parts: _locate_parts(section, parts))
        )

    return F.when(is_blank(content), _empty(f"array<{SECTION}>")).otherwise(
        F.flatten(F.transform(_sections_or_whole(content), refine))
    )


# ---------------------------------------------------------------- masking


def is_fence(trimmed: Column) -> Column:
    return F.startswith(trimmed, F.lit(FENCE))


def is_image(trimmed: Column) -> Column:
    embed = F.contains(trimmed, F.lit("![[")) & F.contains(trimmed, F.lit("]]"))
    return embed | (F.contains(trimmed, F.lit("![")) & trimmed.rlike(IMAGE_LINK))


def is_separator(line: Column) -> Column:
    # The first test is linear and keeps the ambiguous pattern away from prose.
    return line.rlike(rf"^[{SPACE}:\-|]+\z") & line.rlike(SEPARATOR_LINE)


def frontmatter_lines(lines: Column) -> Column:
    """Number of leading lines that form a closed ``---`` block, else 0."""

    def measure(trimmed: Column) -> Column:
        close = F.array_position(F.slice(trimmed, F.lit(2), F.greatest(F.size(trimmed) - 1, F.lit(0))), F.lit("---"))
        return F.when(close > 0, close.cast("int") + 1).otherwise(F.lit(0))

    opened = trim_ws(F.get(lines, F.lit(0))) == "---"
    return F.when(opened, let(F.transform(lines, trim_ws), measure)).otherwise(F.lit(0))


LINE = (
    "struct<line_no:int,raw:string,kind:string,code_lang:string>"
)


def _classified(lines: Column) -> Column:
    """Every line with its kind: frontmatter, fence_start, fence_end, code,
    image, table or text."""

    def facts(skip: Column) -> Column:
        def fact(line: Column, i: Column) -> Column:
            def parts(t: Column) -> Column:
                nxt = F.get(lines, i + 1)
                front = i < skip
                fence = ~front & is_fence(t)
                return F.struct(
                    (i + 1).alias("line_no"),
                    line.alias("raw"),
                    front.alias("front"),
                    fence.alias("fence"),
                    F.when(fence, trim_ws(F.regexp_replace(t, "^```+", ""))).otherwise(F.lit("")).alias("lang"),
                    (~front & is_image(t)).alias("image"),
                    F.contains(line, F.lit("|")).alias("pipe"),
                    F.when(F.contains(line, F.lit("|")), F.coalesce(is_separator(nxt), F.lit(False)))
                    .otherwise(F.lit(False))
                    .alias("sep_next"),
                )

            return let(trim_ws(line), parts)

        return F.transform(lines, fact)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        row = x["pipe"] & (at["table"] | x["sep_next"])
        plain = ~(x["front"] | x["fence"] | at["code"] | x["image"])
        kind = (
            F.when(x["front"], F.lit("frontmatter"))
            .when(x["fence"] & at["code"], F.lit("fence_end"))
            .when(x["fence"], F.lit("fence_start"))
            .when(at["code"], F.lit("code"))
            .when(x["image"], F.lit("image"))
            .when(row, F.lit("table"))
            .otherwise(F.lit("text"))
        )
        line = F.struct(
            x["line_no"].alias("line_no"), x["raw"].alias("raw"), kind.alias("kind"), x["lang"].alias("code_lang")
        )
        after = F.struct((at["code"] != x["fence"]).alias("code"), F.when(plain, row).otherwise(at["table"]).alias("table"))
        return after, F.array(line)

    start = F.struct(F.lit(False).alias("code"), F.lit(False).alias("table"))
    return scan(let(frontmatter_lines(lines), facts), start, LINE, step)


def classify_lines(content: Column) -> Column:
    return let(lines_of(content), _classified)


def mask(line: Column) -> Column:
    kind = line["kind"]
    lang = F.when(line["code_lang"] == "", F.lit("text")).otherwise(line["code_lang"])
    return (
        F.when(kind == "frontmatter", F.lit(MASK_FRONTMATTER))
        .when(kind == "fence_start", F.concat(F.lit(MASK_CODE_START), lang, F.lit("]")))
        .when(kind == "fence_end", F.lit(MASK_CODE_END))
        .when(kind == "code", F.lit(MASK_CODE_LINE))
        .when(kind == "image", F.lit(MASK_IMAGE))
        .when(kind == "table", F.lit(MASK_TABLE))
        .otherwise(line["raw"])
    )


def preprocess(content: Column) -> Column:
    """Mask frontmatter, code, images and tables without changing the line count."""
    return F.array_join(F.transform(classify_lines(content), mask), "\n")


def add_line_numbers(content: Column) -> Column:
    """Prefix every line with its zero-padded 1-based number."""

    def number(lines: Column) -> Column:
        width = F.length(F.size(lines).cast("string"))
        return F.array_join(
            F.transform(
                lines,
                lambda line, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit("0")), F.lit(": "), line),
            ),
            "\n",
        )

    return let(lines_of(content), number)
