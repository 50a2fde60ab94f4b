"""Proposing concepts for notes and applying the reviewer's choice."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.links import DEFAULT_PREFIX
from quillmesh.operators.concepts import concept_aliases, concept_usage, dedup_concepts, resolve_concepts
from quillmesh.operators.notes import new_names, set_concepts, set_indexed_at
from quillmesh.operators.registry import register_batch, touch_concepts, upsert_concepts


class Applied(NamedTuple):
    note_state: DataFrame
    aliases: DataFrame
    usage: DataFrame
    registry: DataFrame


def new_entries(incoming: DataFrame, outcome: DataFrame) -> DataFrame:
    """Registry rows for the concepts a batch created, one per name (the first)."""
    fresh = incoming.join(outcome.filter("is_new").select("ord", "link"), "ord")
    first = fresh.groupBy("name").agg(
        F.min_by(F.struct("reason", "link", "name_vec", "reason_vec"), "ord").alias("f")
    )
    return first.select(
        F.col("name").alias("concept"),
        F.col("f.reason").alias("summary"),
        F.col("f.link").alias("link"),
        F.col("f.name_vec").cast("array<float>").alias("concept_vec"),
        F.col("f.reason_vec").cast("array<float>").alias("concept_summary_vec"),
    )


def propose(incoming: DataFrame, registry: DataFrame, **options) -> DataFrame:
    """Extracted concepts -> rows to review, one per note and resolved name.

    ``incoming``: (ord, note_path, name, confidence, reason, name_vec, reason_vec).
    """
    outcome = register_batch(incoming, registry, **options)
    return dedup_concepts(resolve_concepts(incoming, outcome), extra=["match_info"])


def apply_concepts(
    selected: DataFrame,
    registry: DataFrame,
    note_state: DataFrame,
    now: Column,
    iso_time: Column,
    *,
    prefix: str = DEFAULT_PREFIX,
    **options,
) -> Applied:
    """Register the confirmed concepts of all notes at once and update the notes.

    ``selected``: (ord, note_path, reason, match_info, name_vec, reason_vec),
    the vectors being those of the matched concept and the reason.  Only notes
    with a confirmed concept change.  In the returned registry a created concept counts one
    use, and every match adds one and sets the last use, matches of concepts of the same batch included.
    """
    incoming = selected.withColumn("name", F.col("match_info.matched_concept"))
    outcome = register_batch(incoming, registry, prefix=prefix, **options)
    final = outcome.select("ord", F.col("concept").alias("name")).join(
        incoming.select("ord", "note_path", "match_info"), "ord"
    )
    touched = note_state.join(new_names(final), "note_path", "left")
    merged = set_concepts(touched, prefix)
    stamped = set_indexed_at(merged, F.when(F.col("new_names").isNotNull(), iso_time).otherwise(F.col("me_indexed_at")))
    uses = outcome.filter("matched").select("concept")
    events = final.select(F.col("name").alias("concept"), "note_path", now.alias("ts"))
    return Applied(
        stamped.drop("new_names"),
        concept_aliases(final),
        concept_usage(events),
        touch_concepts(upsert_concepts(registry, new_entries(incoming, outcome), now), uses, now),
    )
