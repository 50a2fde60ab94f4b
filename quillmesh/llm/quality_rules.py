"""Line-first cleaning rules and document counts, in SQL functions only.

Every rule looks at one line; failing lines are removed, and a document is rejected
when the removed lines hold too large a part of its characters.  Nothing is
shuffled: each text is judged inside the projection that reads it.  Repeated word
windows are found by sorting the hashes of a text's own windows, so a long text costs
``n log n`` in its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import let
from quillmesh.llm.common import SEPARATORS

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document that loses more than this share of the characters of its lines is rejected.
MAX_LOST_PERCENT = 50
BOILERPLATE = (
    "cookie policy|privacy policy|terms of use|terms of service|all rights reserved|"
    "enable javascript|click here|sign up now|subscribe to our|add to cart|lorem ipsum"
)


def _count_of(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"[\x20\x09-\x0D]+", -1), lambda w: w != F.lit(""))


def has_word(c: Column) -> Column:
    return c.rlike(r"[^\x20\x09-\x0D]")


def line_fails(line: Column) -> Column:
    """Whether a line that has a word is to be removed."""
    return let(
        F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")),
        lambda words: (
            # punctuation: nothing but marks, or shouting
            ~line.rlike(r"[\p{L}\p{N}]")
            | ((words >= 3) & (2 * _count_of(line, "!?") >= words))
            # symbols, and bars between menu items
            | (10 * _count_of(line, SYMBOLS) >= 3 * words)
            # navigation: one or two words that end no sentence
            | ((words <= 2) & ~line.rlike(r"[.!?:;\x{3002}][)\x22']*[\x20\x09-\x0D]*$"))
            # a whole line in capitals
            | ((words >= 5) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"))
            | F.lower(line).rlike(BOILERPLATE)
        ),
    )


def _covered(windows: Column) -> Column:
    """Words inside windows of three whose hash occurs twice, from (hash, position) in order."""
    repeated = let(
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda s: F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    return let(
        repeated,
        lambda at: F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))),
            F.lit(0).cast("bigint"),
            lambda total, n: total + n,
        ),
    )


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in ``words``."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    counted = let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(_covered(w)),
    )
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(counted)


def _line_facts(lines: Column) -> Column:
    return let(
        lines,
        lambda ls: F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("dup"),
            F.aggregate(
                F.transform(ls, lambda x: F.length(x).cast("bigint")), F.lit(0).cast("bigint"), lambda t, n: t + n
            ).alias("all_chars"),
            F.aggregate(
                F.transform(ls, lambda x: F.when(line_fails(x), F.length(x)).otherwise(F.lit(0)).cast("bigint")),
                F.lit(0).cast("bigint"),
                lambda t, n: t + n,
            ).alias("lost_chars"),
        ),
    )


def clean_lines(text: Column) -> Column:
    """The text without its failing lines; blank lines stay, NULL stays NULL."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~has_word(x) | ~line_fails(x)), "\n")


def _fails(words: Column, repeated: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def _loses(lost: Column, whole: Column) -> Column:
    return 100 * lost > MAX_LOST_PERCENT * whole


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row with its counts and ``kept``.

    NULL and empty texts have no words, so they fail the word count.  Repeated rows are
    judged one by one; other columns of the input are neither read nor returned.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(
        F.col(id_col),
        F.length(F.translate(text, SEPARATORS, "")).cast("bigint").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        let(
            words_of(text),
            lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("repeat")),
        ).alias("w"),
        _line_facts(F.filter(F.split(text, "\n", -1), has_word)).alias("l"),
    )
    counted = facts.select(
        id_col,
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.repeat").alias("n_repeat_words"),
        F.col("l.all_chars").alias("line_chars"),
        F.col("l.lost_chars").alias("lost_chars"),
    )
    judged = counted.withColumn("base_failed", _fails(F.col("n_words"), F.col("n_repeat_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & ~_loses(F.col("lost_chars"), F.col("line_chars")))


def keep_clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows that ``quality`` keeps; all columns stay as they are, texts included.

    Rejection is this operator's effect; ``clean_lines`` gives the text without the failing lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # one expression for each side, so that the filter computes neither twice
    passes = let(words_of(text), lambda w: let(repeated_words(w), lambda r: ~_fails(F.size(w), r)))
    whole = let(_line_facts(F.filter(F.split(text, "\n", -1), has_word)), lambda f: ~_loses(f["lost_chars"], f["all_chars"]))
    return docs.where(passes & whole)
