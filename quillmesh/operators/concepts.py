"""Concept rows of notes: deduplication, filters, review, usage, relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions import links
from quillmesh.functions.metadata import concept_details
from quillmesh.functions.text import trim_ws
from quillmesh.session import materialize

# Declared defaults of the concept filter and the skip rules.
MIN_CONFIDENCE = 0.7
MAX_CONCEPTS_PER_NOTE = 5
GENERIC_CONCEPTS = ["技术开发", "总结", "概述", "简介", "设计"]
SKIP_PATHS = ["_me/", "templates/", "daily/"]
SKIP_TAGS = ["vocabulary", "daily", "template", "image-collection"]
MIN_TEXT_LENGTH = 100

# A set of target notes up to this many rows may be broadcast.
BROADCAST_TARGETS = 10_000


def concept_rows(annotated: DataFrame) -> DataFrame:
    """Annotated chunks -> (note_path, index, pos, name, confidence, reason)."""
    details = concept_details(F.col("metadata.concepts"), F.col("metadata.summary"), F.col("header_path"))
    return annotated.select("note_path", "index", F.posexplode(details).alias("pos", "d")).select(
        "note_path", "index", "pos", "d.name", "d.confidence", "d.reason"
    )


def dedup_concepts(rows: DataFrame, order: Sequence[str] = ("ord",), extra: Sequence[str] = ()) -> DataFrame:
    """One row per note and case-insensitive name.

    Strictly highest confidence wins, ties keep the first; ``first_ord`` is the
    position at which the name first appeared.  An aggregation with map-side
    combine, so a note or name with very many rows is reduced before the shuffle.
    """
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    keep = ["name", "confidence", "reason", *extra]
    best = F.min(F.struct((-F.col("confidence")).alias("c"), position.alias("o"), *keep))
    out = rows.groupBy("note_path", F.lower("name").alias("_key")).agg(
        F.min(position).alias("first_ord"), best.alias("b")
    )
    return out.select("note_path", "first_ord", *[F.col(f"b.{x}").alias(x) for x in keep])


def resolve_concepts(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Extracted concepts joined to their registry match (keyed by ``ord``)."""
    m = matches.select("ord", F.col("concept").alias("_concept"), "similarity", "is_new")
    return rows.join(m, "ord", "left").select(
        "ord",
        "note_path",
        F.col("_concept").alias("name"),
        "confidence",
        "reason",
        F.struct(
            F.col("name").alias("original_term"),
            F.col("_concept").alias("matched_concept"),
            F.when(F.col("is_new"), F.lit("new")).otherwise(F.lit("alias")).alias("match_type"),
            F.col("similarity").alias("confidence"),
        ).alias("match_info"),
    )


def dedup_merge_reasons(rows: DataFrame, *, flat_reasons: bool = False) -> DataFrame:
    """One row per note and trimmed lower-case name, with merged reasons.

    Reasons merge pairwise from left to right into ``"a; b"``; an already joined
    text counts as one reason, so ``a, b, a`` gives ``a; b; a``.  With
    ``flat_reasons`` each distinct reason appears once.  The list folded here is
    one note's mentions of one name; its length is that of the produced text.
    """
    key = F.lower(trim_ws(F.col("name")))
    item = F.struct("ord", "name", "confidence", trim_ws(F.coalesce("reason", F.lit(""))).alias("t"), "reason")

    def step(acc: Column, x: Column) -> Column:
        old = trim_ws(F.coalesce(acc["reason"], F.lit("")))
        pair = F.array_join(
            F.array_distinct(F.filter(F.array(old, x["t"]), lambda r: r != "")), "; "
        )
        wins = x["confidence"] > acc["confidence"]
        return F.struct(
            F.when(wins, x["name"]).otherwise(acc["name"]).alias("name"),
            F.when(wins, x["confidence"]).otherwise(acc["confidence"]).alias("confidence"),
            pair.alias("reason"),
        )

    first = F.get("items", F.lit(0))
    folded = F.aggregate(
        F.slice("items", F.lit(2), F.size("items")),
        F.struct(first["name"].alias("name"), first["confidence"].alias("confidence"), first["reason"].alias("reason")),
        step,
    )
    out = (
        rows.groupBy("note_path", key.alias("_key"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select("note_path", first["ord"].alias("first_ord"), folded.alias("f"), "items")
    )
    flat = F.array_join(
        F.array_distinct(F.filter(F.transform("items", lambda x: x["t"]), lambda r: r != "")), "; "
    )
    return out.select(
        "note_path",
        "first_ord",
        "f.name",
        "f.confidence",
        (flat if flat_reasons else F.col("f.reason")).alias("reason"),
    )


def filter_concepts(
    rows: DataFrame,
    *,
    min_confidence: float = MIN_CONFIDENCE,
    exclude: Sequence[str] = tuple(GENERIC_CONCEPTS),
    max_concepts: int = MAX_CONCEPTS_PER_NOTE,
) -> DataFrame:
    """Confident, specific concepts, at most ``max_concepts`` per note."""
    if not 1 <= max_concepts <= 20:
        raise ValueError("max_concepts must be between 1 and 20")
    if not 0 <= min_confidence <= 1:
        raise ValueError("min_confidence must be between 0 and 1")
    kept = rows.filter((F.col("confidence") >= min_confidence) & ~F.col("name").isin(list(exclude)))
    w = W.partitionBy("note_path").orderBy(F.desc("confidence"), "ord")
    return kept.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= max_concepts)


def skip_notes(
    notes: DataFrame,
    *,
    paths: Sequence[str] = tuple(SKIP_PATHS),
    tags: Sequence[str] = tuple(SKIP_TAGS),
    min_length: int = MIN_TEXT_LENGTH,
) -> DataFrame:
    """Notes that are worth extracting from."""
    skip = F.length("content") < min_length
    for prefix in paths:
        skip = skip | F.startswith("note_path", F.lit(prefix))
    if tags:
        skip = skip | F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])), F.lit(False))
    return notes.filter(~skip)


def review_select(proposed: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """Proposed rows whose file and whose name are both selected."""
    return proposed.join(files.select("note_path").distinct(), "note_path", "left_semi").join(
        names.select("name").distinct(), "name", "left_semi"
    )


def review_reject(proposed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Proposed rows without the rejected (note, name) pairs."""
    return proposed.join(rejected.select("note_path", "name"), ["note_path", "name"], "left_anti")


def concept_usage(events: DataFrame) -> DataFrame:
    """Match events -> usage count, first and last use, distinct notes."""
    return events.groupBy("concept").agg(
        F.count(F.lit(1)).alias("note_count"),
        F.min("ts").alias("first_seen_at"),
        F.max("ts").alias("last_used_at"),
        F.count_distinct("note_path").alias("distinct_notes"),
    )


def all_concepts(note_state: DataFrame) -> DataFrame:
    """Distinct concept names listed in any note, ascending."""
    link = note_state.select(F.explode("me_concepts").alias("link"))
    return (
        link.filter(F.col("link").rlike(links.LISTED_LINK))
        .select(F.regexp_extract("link", links.LISTED_LINK, 1).alias("concept"))
        .distinct()
        .orderBy("concept")
    )


def concept_aliases(applied: DataFrame) -> DataFrame:
    """(alias, concept) pairs from applied alias matches."""
    info = F.col("match_info")
    return (
        applied.filter(info["match_type"] == "alias")
        .select(info["original_term"].alias("alias"), info["matched_concept"].alias("concept"))
        .distinct()
    )


#: Notes of one link that meet its targets in one piece, about.
SALT_ROWS = 10_000
#: Links of a note, or a target, whose subsets are listed; longer lists meet by link.
SUBSET_LINKS = 6


#: Mentions from which on a link is popular: with a limit, it is opened for a target only if it can change its list.
POPULAR_MENTIONS = 5_000


def related_by_concept(targets: DataFrame, note_state: DataFrame, limit: int | None = None) -> DataFrame:
    """Other notes that share stored links with the target notes.

    Returns (target_path, note_path, shared, shared_count, rank): shared links in
    the other note's order with repeats kept, most shared first, ties by path;
    with ``limit`` only the first so many of each target.
    A bounded set of targets is broadcast and the notes are scanned in place;
    otherwise the two exploded link lists meet by link, the target side salted so
    that one popular link is spread over many tasks.  With a limit, only the first holders of the links that a
    target has are opened (see ``_best_shared``).
    """
    wanted = targets.filter(F.size("me_concepts") > 0).select(
        F.col("note_path").alias("target_path"), F.explode(F.array_distinct("me_concepts")).alias("link")
    )
    have = note_state.filter(F.size("me_concepts") > 0).select(
        "note_path", F.posexplode("me_concepts").alias("pos", "link")
    )
    if limit is not None:
        counted = _best_shared(targets, note_state, limit)
        # Spark keeps the best rows of each task before it moves any
        w = W.partitionBy("target_path").orderBy(F.desc("shared_count"), "note_path")
        return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    # one target may have most of the notes: sort by ranges, and number each range from where the one before ends
    counted = _shared(wanted, have)
    order = [F.desc("shared_count"), F.col("note_path")]
    ranged = counted.repartitionByRange("target_path", *order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "related")
    sizes = ranged.groupBy("target_path", "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy("target_path").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("target_path", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = W.partitionBy("target_path", "_range").orderBy(*order)
    numbered = ranged.withColumn("rank", F.row_number().over(own)).join(starts, ["target_path", "_range"])
    return numbered.select(*counted.columns, (F.col("rank") + F.col("_before")).alias("rank"))


def _listed(notes: DataFrame, path: str) -> DataFrame:
    """(path, entries, links, parts): all links of a path with their positions, the distinct ones, and in how many rows they came."""
    rows = notes.filter((F.size("me_concepts") > 0) & F.col("note_path").isNotNull())
    own = rows.select(F.col("note_path").alias(path), F.posexplode("me_concepts").alias("pos", "link"))
    merged = own.filter("link is not null").groupBy(path).agg(F.sort_array(F.collect_list(F.struct("pos", "link"))).alias("entries"))
    parts = rows.groupBy(F.col("note_path").alias(path)).agg(F.count("*").alias("parts"))
    return merged.join(parts, path).withColumn("links", F.array_sort(F.array_distinct(F.transform("entries", lambda x: x["link"]))))


def _subsets(df: DataFrame) -> DataFrame:
    """One row per non-empty subset of the few ``links``."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("links")) - 1)
    return df.withColumn("_mask", F.explode(masks)).withColumn("subset", F.filter("links", lambda x, i: F.call_function("getbit", F.col("_mask"), i) == 1)).drop("_mask")


def _best_shared(targets: DataFrame, note_state: DataFrame, limit: int) -> DataFrame:
    """Shared links of every pair that can be among a target's first ``limit``, without opening a link's whole list.

    Let S be the links that a note shares with a target.  Notes that come before it among the holders of S, by mentions of S and
    path, share at least as much with the target, so a note of the target's first ``limit`` is among the first
    ``limit`` + 1 holders of S (the target may be one).  Holders are listed for every subset of a note's links; notes and targets
    of more than SUBSET_LINKS links, and targets whose path comes more than once, meet all notes by link.
    """
    notes = materialize(_listed(note_state, "note_path"), "listed-notes")
    wanted = materialize(_listed(targets, "target_path"), "listed-targets")
    few = F.size("links") <= SUBSET_LINKS
    simple = few & (F.col("parts") == 1)
    holders = _subsets(notes.filter(few)).select("subset", "note_path", F.size(F.filter("entries", lambda x: F.array_contains("subset", x["link"]))).alias("n"))
    first = W.partitionBy("subset").orderBy(F.desc("n"), "note_path")
    heads = holders.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= limit + 1).select("subset", "note_path")
    asking = _subsets(wanted.filter(simple)).select("subset", "target_path")
    # a subset of very many targets is spread over tasks
    crowded = asking.groupBy("subset").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")).where("salts > 1")
    salts = F.coalesce("salts", F.lit(1))
    asking = asking.join(crowded, "subset", "left").withColumn("salt", F.pmod(F.xxhash64("target_path"), salts).cast("int")).drop("salts")
    heads = heads.join(crowded, "subset", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    met = asking.join(heads, ["subset", "salt"]).where(F.col("note_path") != F.col("target_path")).select("target_path", "note_path").distinct()
    shared = F.transform(F.filter("entries", lambda x: F.array_contains("links", x["link"])), lambda x: x["link"])
    full = met.join(wanted.select("target_path", "links"), "target_path").join(notes.select("note_path", "entries"), "note_path")
    counted = full.select("target_path", "note_path", shared.alias("shared")).withColumn("shared_count", F.size("shared"))
    # the rest meets by link
    own = targets.filter(F.size("me_concepts") > 0).select(F.col("note_path").alias("target_path"), F.explode(F.array_distinct("me_concepts")).alias("link"))
    odd, long = wanted.filter(~simple).select("target_path"), notes.filter(~few).select("note_path")
    if not odd.isEmpty():
        counted = counted.unionByName(_by_links(own.join(odd, "target_path", "left_semi"), note_state, limit))
    if not long.isEmpty():
        counted = counted.unionByName(_by_links(own.join(odd, "target_path", "left_anti"), note_state.join(long, "note_path", "left_semi"), limit))
    return counted


def _by_links(wanted: DataFrame, note_state: DataFrame, limit: int) -> DataFrame:
    have = note_state.filter(F.size("me_concepts") > 0).select("note_path", F.posexplode("me_concepts").alias("pos", "link"))
    popular = _popular(note_state, wanted)
    return _shared(wanted, have) if popular.isEmpty() else _without_popular(wanted, have, note_state, popular, limit)


def _pairs(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Every mention of a wanted link in another note."""
    if wanted.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS:
        pairs = have.join(F.broadcast(wanted), "link")
    else:
        # a piece holds some thousand notes of a link, however many notes list it
        popular = have.groupBy("link").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")).where("salts > 1")
        salts = F.coalesce("salts", F.lit(1))
        salted = wanted.join(popular, "link", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        spread = have.join(popular, "link", "left").withColumn("salt", F.pmod(F.xxhash64("note_path"), salts).cast("int")).drop("salts")
        pairs = spread.join(salted, ["link", "salt"])
    return pairs.filter(F.col("note_path") != F.col("target_path"))


def _shared(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(target_path, note_path, shared, shared_count) of all pairs with a shared link."""
    shared = _pairs(wanted, have).groupBy("target_path", "note_path").agg(F.sort_array(F.collect_list(F.struct("pos", "link"))).alias("s"))
    return shared.select("target_path", "note_path", F.transform("s", lambda x: x["link"]).alias("shared"), F.size("s").alias("shared_count"))


def _popular(note_state: DataFrame, wanted: DataFrame) -> DataFrame:
    """(link, most): wanted links of very many mentions, and how often one note may list each at most."""
    mentions = note_state.filter(F.size("me_concepts") > 0).select(
        F.explode("me_concepts").alias("link"), (F.size("me_concepts") - F.size(F.array_distinct("me_concepts")) + 1).alias("repeats")
    )
    counts = mentions.groupBy("link").agg(F.count("*").alias("mentions"), F.max("repeats").alias("most"))
    popular = counts.filter(F.col("mentions") > POPULAR_MENTIONS).join(wanted.select("link").distinct(), "link", "left_semi")
    return materialize(popular.select("link", "most"), "popular")


def _without_popular(wanted: DataFrame, have: DataFrame, note_state: DataFrame, popular: DataFrame, limit: int) -> DataFrame:
    """Shared links of every pair that can be among a target's first ``limit``.

    Rare links are opened first and give each target a ``limit``-th count.  Its popular links together add a
    bounded count to any note.  A note that shares only popular links cannot enter the list if that bound
    is below the ``limit``-th count; then only the notes already met are completed, from their own lists.
    The other targets open all their links.
    """
    rare = materialize(_pairs(wanted.join(popular, "link", "left_anti"), have).groupBy("target_path", "note_path").agg(F.count("*").alias("part")), "rare-pairs")
    nth = F.row_number().over(W.partitionBy("target_path").orderBy(F.desc("part"), "note_path"))
    least = rare.withColumn("_n", nth).filter(F.col("_n") == limit).select("target_path", F.col("part").alias("least"))
    bound = wanted.join(popular, "link").groupBy("target_path").agg(F.sum("most").alias("bound"))
    state = wanted.select("target_path").distinct().join(bound, "target_path", "left").join(least, "target_path", "left")
    state = state.select("target_path", F.coalesce("bound", F.lit(0)).alias("bound"), F.coalesce("least", F.lit(0)).alias("least"))
    state = materialize(state.withColumn("opened", (F.col("bound") > 0) & (F.col("bound") >= F.col("least"))), "targets")
    full = _shared(wanted.join(state.filter("opened"), "target_path", "left_semi"), have)
    near = rare.join(state.filter("not opened"), "target_path").filter(F.col("part") + F.col("bound") >= F.col("least"))
    own = wanted.groupBy("target_path").agg(F.collect_list("link").alias("_links"))
    lists = note_state.filter(F.size("me_concepts") > 0).select("note_path", "me_concepts")
    met = near.select("target_path", "note_path").join(own, "target_path").join(lists, "note_path")
    shared = F.filter("me_concepts", lambda x: F.array_contains("_links", x))
    closed = met.select("target_path", "note_path", shared.alias("shared")).withColumn("shared_count", F.size("shared"))
    return full.unionByName(closed)
