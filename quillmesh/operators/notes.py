"""State kept in note frontmatter: reading, staleness, concept lists, clearing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import links
from quillmesh.functions import markdown as md
from quillmesh.functions.text import let, lines_of, trim_ws


def stamp(text: Column) -> Column:
    """ISO text -> timestamp, NULL when it is not a date."""
    return F.try_to_timestamp(text)


def needs_reindex() -> Column:
    """True without an index stamp, or when the note is strictly newer.

    A stamp that is not a date never triggers re-indexing.
    """
    at = F.col("me_indexed_at")
    newer = F.coalesce(F.col("mtime") > stamp(at), F.lit(False))
    return at.isNull() | (at == "") | newer


def indexed_after(note_state: DataFrame, moment: Column) -> DataFrame:
    return note_state.filter(F.coalesce(stamp(F.col("me_indexed_at")) > moment, F.lit(False)))


def indexed_within(note_state: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return indexed_after(note_state, now - F.make_interval(days=F.lit(days)))


def new_names(rows: DataFrame) -> DataFrame:
    """(note_path, ord, name) rows -> one ordered array of distinct names per note."""
    first = rows.groupBy("note_path", "name").agg(F.min("ord").alias("ord"))
    return (
        first.groupBy("note_path")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("s"))
        .select("note_path", F.transform("s", lambda x: x["name"]).alias("new_names"))
    )


def set_concepts(note_state: DataFrame, prefix: str = links.DEFAULT_PREFIX) -> DataFrame:
    """Add ``new_names`` to the stored links; nothing new leaves the note alone."""
    merged = links.merge_links(F.col("me_concepts"), F.col("new_names"), prefix)
    nothing = F.coalesce(F.size("new_names"), F.lit(0)) <= 0
    return note_state.withColumn("me_concepts", F.when(nothing, F.col("me_concepts")).otherwise(merged))


def set_indexed_at(note_state: DataFrame, iso_time: Column) -> DataFrame:
    return note_state.withColumn("me_indexed_at", iso_time)


def update_after_indexing(note_state: DataFrame, iso_time: Column, prefix: str = links.DEFAULT_PREFIX) -> DataFrame:
    """Merge the names and stamp the time; stored links are rewritten in any case."""
    merged = links.merge_links(F.col("me_concepts"), F.col("new_names"), prefix)
    return set_indexed_at(note_state.withColumn("me_concepts", merged), iso_time)


def has_state() -> Column:
    """An empty concept list counts as state, an empty stamp does not."""
    return F.col("me_concepts").isNotNull() | (F.coalesce(F.col("me_indexed_at"), F.lit("")) != "")


def clear_fields(note_state: DataFrame, where: Column | None = None) -> DataFrame:
    """Remove both fields from the selected notes (default: every note with state)."""
    hit = F.coalesce(has_state() if where is None else where, F.lit(False))
    return note_state.withColumn("cleared", hit).select(
        *[
            F.when(hit, F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("me_concepts", "me_indexed_at") else F.col(c)
            for c in note_state.columns
        ],
        "cleared",
    )


def clear_summary(cleared: DataFrame, failed: Column | None = None) -> DataFrame:
    bad = F.lit(False) if failed is None else failed
    return cleared.agg(
        F.count_if(F.col("cleared") & ~bad).alias("cleared"), F.count_if(F.col("cleared") & bad).alias("failed")
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """(note_path, n_concepts, error) rows -> totals of a batch run."""
    failed = F.col("error").isNotNull()
    return results.agg(
        F.count(F.lit(1)).alias("files_total"),
        F.count_if(~failed).alias("files_processed"),
        F.count_if(failed).alias("files_failed"),
        F.coalesce(F.sum(F.when(~failed, F.col("n_concepts"))), F.lit(0)).alias("concepts_total"),
    ).withColumn(
        "percent",
        F.when(F.col("files_total") == 0, F.lit(0)).otherwise(
            F.floor(F.col("files_processed") * F.lit(100.0) / F.col("files_total") + F.lit(0.5))
        ),
    )


def read_state(notes: DataFrame) -> DataFrame:
    """Read both fields from the frontmatter block of the note text.

    Supports the list (``- item``), inline (``[a, b]``) and scalar forms the
    fields are written in; a note without a closed block has neither field.
    """

    def unquote(c: Column) -> Column:
        return F.regexp_replace(trim_ws(c), "^[\"']|[\"']\\z", "")

    def fields(block: Column) -> Column:
        listing = F.regexp_extract(block, r"(?:^|\n)me_concepts:[ \t]*\n((?:[ \t]*- [^\n]*(?:\n|\z))+)", 1)
        inline = F.regexp_extract(block, r"(?:^|\n)me_concepts:[ \t]*\[([^\n]*)\][ \t]*(?:\n|\z)", 1)
        is_inline = block.rlike(r"(?:^|\n)me_concepts:[ \t]*\[[^\n]*\][ \t]*(?:\n|\z)")
        from_list = F.transform(
            F.filter(lines_of(listing), lambda x: trim_ws(x) != ""),
            lambda x: unquote(F.regexp_replace(x, r"^[ \t]*- ", "")),
        )
        from_inline = F.filter(
            F.transform(F.regexp_extract_all(inline, F.lit("(\"[^\"]*\"|'[^']*'|[^,]+)"), F.lit(1)), unquote),
            lambda x: x != "",
        )
        at = F.regexp_extract(block, r"(?:^|\n)me_indexed_at:[ \t]*([^\n]*)", 1)
        return F.struct(
            F.when(listing != "", from_list).when(is_inline, from_inline).alias("me_concepts"),
            F.when(block.rlike(r"(?:^|\n)me_indexed_at:"), unquote(at)).alias("me_indexed_at"),
        )

    block = let(
        lines_of(F.col("content")),
        lambda ls: let(
            md.frontmatter_lines(ls),
            lambda n: F.when(n > 0, F.array_join(F.slice(ls, F.lit(2), F.greatest(n - 2, F.lit(0))), "\n")).otherwise(
                F.lit("")
            ),
        ),
    )
    return notes.withColumn("_state", let(block, fields)).select(
        "note_path", "_state.me_concepts", "_state.me_indexed_at"
    )
