"""String helpers with the whitespace rules of note text.

Lengths count code points.  Text outside the Basic Multilingual Plane would
count differently under UTF-16 rules; see the README.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that count as whitespace when trimming note text,
# as a pattern class and as plain characters.
SPACE = (
    r"\t\n\x{0B}\f\r\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Catalyst substitutes a column expression wherever it is referenced, so a
    split or parse used inside a lambda would run again for every element.
    A one-element ``transform`` evaluates it exactly once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the columns that a function of plain values builds.

    A large expression takes thousands of calls to the JVM, a second or more, and is the same every time;
    jobs that run again and again, such as the batches of a stream, build it once.
    """
    made: dict[tuple, Column] = {}

    @functools.wraps(build)
    def get(*args) -> Column:
        key = (id(SparkContext._gateway), *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]

    return get


def numbered(df: DataFrame, array: str, *keep: str, pos: str, item: str) -> DataFrame:
    """One row per element of a computed array column, with its position; none for empty arrays.

    An inner generator lets Catalyst infer a filter on the array's size and push it below the projections
    that compute the array, which then runs twice.  An outer one does not.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def ltrim_ws(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE_CHARS))


def rtrim_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    """NULL or whitespace only; stops at the first other character."""
    return ~F.coalesce(c.rlike(f"[^{SPACE}]"), F.lit(False))


def or_else(c: Column, *fallbacks: Column) -> Column:
    """First value that is neither NULL nor the empty string; else the last one."""
    *firsts, last = (c, *fallbacks)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in firsts], last)


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def percent_badge(score: Column) -> Column:
    """Half-up percentage of a 0..1 score (floor(x * 100 + 0.5))."""
    return F.floor(score * F.lit(100.0) + F.lit(0.5))


def nonblank_queries(df, text_col: str = "query"):
    """Drop queries that hold only whitespace."""
    return df.filter(~is_blank(F.col(text_col)))


#: Elements that a scan folds before it starts a new piece of its output.
SCAN_BLOCK = 256


def scan(
    items: Column,
    state: Column,
    out_type: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
    finish: Callable[[Column], Column] | None = None,
) -> Column:
    """Run ``step(state, item) -> (state, array of outputs)`` over an array and collect the outputs.

    A plain fold that appends to its result copies the result at every step, which makes long arrays cost the
    square of their length.  Here the fold runs over blocks: a step copies at most the outputs
    of its own block, and blocks are flattened once at the end.  ``finish(state)`` gives last outputs.
    """
    none = F.array().cast(f"array<{out_type}>")
    nested = F.array().cast(f"array<array<{out_type}>>")

    def one(acc: Column, item: Column) -> Column:
        new, out = step(acc["state"], item)
        return F.struct(new.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), none.alias("out"))
        return let(
            F.aggregate(part, start, one),
            lambda done: F.struct(done["state"].alias("state"), F.concat(acc["out"], F.array(done["out"])).alias("out")),
        )

    def close(acc: Column) -> Column:
        last = F.array(finish(acc["state"])) if finish else nested
        return F.flatten(F.concat(acc["out"], last))

    def blocks(all_items: Column) -> Column:
        count = F.greatest(F.ceil(F.size(all_items) / F.lit(SCAN_BLOCK)).cast("int"), F.lit(1))
        cut = F.transform(
            F.sequence(F.lit(0), count - 1), lambda b: F.slice(all_items, b * F.lit(SCAN_BLOCK) + 1, F.lit(SCAN_BLOCK))
        )
        return F.aggregate(cut, F.struct(state.alias("state"), nested.alias("out")), block, close)

    return let(items, blocks)


def running_starts(lengths: Column) -> Column:
    """0 and the sums of all but the last of the lengths: where each of the joined pieces begins."""
    return scan(lengths, F.lit(0), "int", lambda at, n: (at + n, F.array(at)))


def pieces_of(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters, the remainder last; one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
