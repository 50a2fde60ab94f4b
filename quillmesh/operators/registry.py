"""Concept registry: matching, registration, usage and paging."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.links import DEFAULT_PREFIX, wrap
from quillmesh.functions.text import let
from quillmesh.functions.vectors import cosine_similarity
from quillmesh.operators.fusion import rrf_fusion
from quillmesh.operators.knn import nearest
from quillmesh.operators.topk_kernel import SCORE_DECIMALS
from quillmesh.operators.tiles import Lists, earliest_near, earliest_near_few, fit_lists, into_lists
from quillmesh.session import discard, materialize

# Thresholds, page size, and the rank constant of the concept fusion
# (score 1.0 exactly when one concept is nearest by name and by reason).
STRICT_THRESHOLD = 0.90
LOOSE_THRESHOLD = 0.85
PAGE_SIZE = 100
CONCEPT_RRF_K = 1
CONCEPT_VECTORS = (("concept_vec", "name_vec", "concept_vec"), ("concept_summary_vec", "reason_vec", "concept_summary_vec"))


def strict_match(
    incoming: DataFrame, registry: DataFrame, *, threshold: float = STRICT_THRESHOLD, limit: int = 1, **knn_options
) -> DataFrame:
    """Concepts whose name vector is close enough: (ord, concept, score, rank)."""
    return nearest(
        incoming,
        registry,
        limit,
        vectors=[("concept_vec", "name_vec", "concept_vec")],
        query_key="ord",
        item_key="concept",
        min_score=threshold,
        **knn_options,
    ).drop("vec_name")


def loose_match(
    incoming: DataFrame,
    registry: DataFrame,
    *,
    threshold: float = LOOSE_THRESHOLD,
    limit: int = 1,
    k: int = CONCEPT_RRF_K,
    min_cosine: float | None = None,
    **knn_options,
) -> DataFrame:
    """Fusion of the name and reason neighbours: (ord, concept, score, rank).

    With ``k=1`` this asks that the same concept be nearest on both vectors.
    ``min_cosine`` additionally drops neighbours below a cosine (default off).
    """
    ranked = nearest(
        incoming,
        registry,
        2 * limit,
        vectors=CONCEPT_VECTORS,
        query_key="ord",
        item_key="concept",
        min_score=min_cosine,
        **knn_options,
    )
    return rrf_fusion(
        ranked,
        [v[0] for v in CONCEPT_VECTORS],
        limit,
        k=k,
        query_key="ord",
        item_key="concept",
        min_score=threshold,
    )


def register_or_match(
    incoming: DataFrame,
    registry: DataFrame,
    *,
    strict: float = STRICT_THRESHOLD,
    loose: float | None = LOOSE_THRESHOLD,
    prefix: str = DEFAULT_PREFIX,
    min_cosine: float | None = None,
    **knn_options,
) -> DataFrame:
    """Match every incoming concept against the registry snapshot.

    The strict score is the nearest name's cosine, the loose one the agreement of the name and reason neighbours.
    Where a threshold asks that one concept be nearest on both vectors, as the default does, the nearest name is looked for first, and
    reasons only of what it leaves unmatched: whether any concept has a better reason than that one.  A lower
    threshold takes two neighbours per vector, in one pass over the registry.
    Returns (ord, matched, concept, summary, similarity, is_new, link, match_kind).
    """
    if loose is None or 1 / (CONCEPT_RRF_K + 1) + 1 / (CONCEPT_RRF_K + 2) < loose:
        base = _nearest_on_both(incoming, registry, strict, loose, min_cosine, knn_options)
    else:
        base = _two_of_each(incoming, registry, strict, loose, min_cosine, knn_options)
    return _outcome(incoming.select("ord", "name", "reason").join(base, "ord", "left"), registry, prefix)


def _nearest_on_both(
    incoming: DataFrame, registry: DataFrame, strict: float, loose: float | None, min_cosine: float | None, knn_options: dict
) -> DataFrame:
    """(ord, strict_concept, strict_score, loose_concept, loose_score): what is nearest by name, and by reason as well."""
    by_name = nearest(incoming, registry, 1, vectors=CONCEPT_VECTORS[:1], query_key="ord", item_key="concept", **knn_options)
    best = F.min(F.struct((-F.col("score")).alias("s"), "concept"))
    named = materialize(by_name.groupBy("ord").agg(best.alias("b")).select("ord", "b.concept", (-F.col("b.s")).alias("score")), "named")
    is_strict = F.col("score") >= strict
    agreed = 2 / (CONCEPT_RRF_K + 1)
    if loose is None or agreed < loose:
        both = named.select("ord", F.lit(None).cast("string").alias("agreed"))
    else:
        likely = named.filter(~is_strict) if min_cosine is None else named.filter(~is_strict & (F.col("score") >= min_cosine))
        known = cosine_similarity(F.col("reason_vec"), F.col("concept_summary_vec"))
        # a concept of the same reason score has the place of its name
        asked = (
            incoming.select("ord", "reason_vec")
            .join(likely.select("ord", "concept"), "ord")
            .join(registry.select("concept", "concept_summary_vec"), "concept", "left")
            .withColumn("known", F.round(F.nanvl(known, F.lit(None).cast("double")), SCORE_DECIMALS))
            .withColumn("known", F.max("known").over(W.partitionBy("ord")))
            .select("ord", "reason_vec", "known")
        )
        by_reason = nearest(
            asked, registry, 1, vectors=CONCEPT_VECTORS[1:], query_key="ord", item_key="concept",
            min_score=min_cosine, query_floor="known", settle=True, **knn_options,
        )
        both = likely.select("ord", "concept").join(by_reason.select("ord", "concept"), ["ord", "concept"]).select("ord", F.col("concept").alias("agreed")).distinct()
    return named.join(both, "ord", "left").select(
        "ord",
        F.when(is_strict, F.col("concept")).alias("strict_concept"),
        F.when(is_strict, F.col("score")).alias("strict_score"),
        F.col("agreed").alias("loose_concept"),
        F.when(F.col("agreed").isNotNull(), F.lit(agreed)).alias("loose_score"),
    )


def _two_of_each(
    incoming: DataFrame, registry: DataFrame, strict: float, loose: float, min_cosine: float | None, knn_options: dict
) -> DataFrame:
    """The same for any threshold, from two neighbours per vector."""
    ranked = nearest(
        incoming, registry, 2, vectors=CONCEPT_VECTORS, query_key="ord", item_key="concept", **knn_options
    )
    # At most two neighbours per vector: four entries per item, already on one task.
    found = ranked.groupBy("ord").agg(F.collect_list(F.struct("vec_name", "rank", "concept", "score")).alias("near"))
    by_name = F.filter("near", lambda x: (x["vec_name"] == "concept_vec") & (x["rank"] == 1) & (x["score"] >= strict))
    eligible = F.col("near") if min_cosine is None else F.filter("near", lambda x: x["score"] >= min_cosine)
    return found.select("ord", F.get(by_name, F.lit(0)).alias("s"), _agreed(eligible, loose).alias("l")).select(
        "ord",
        F.col("s.concept").alias("strict_concept"),
        F.col("s.score").alias("strict_score"),
        F.col("l.concept").alias("loose_concept"),
        F.col("l.score").alias("loose_score"),
    )


def _agreed(near: Column, threshold: float) -> Column:
    """Best fused neighbour of one item, or NULL below the threshold.

    The same ranking as ``loose_match`` for a list of a few entries.
    """

    def rank_in(entries: Column, vec_name: str, concept: Column) -> Column:
        hit = F.filter(entries, lambda x: (x["vec_name"] == vec_name) & (x["concept"] == concept))
        return F.get(hit, F.lit(0))["rank"]

    def fuse(entries: Column) -> Column:
        def one(concept: Column) -> Column:
            r = [rank_in(entries, v[0], concept) for v in CONCEPT_VECTORS]
            score = sum((F.coalesce(F.lit(1.0) / (F.lit(float(CONCEPT_RRF_K)) + x), F.lit(0.0)) for x in r[1:]),
                        F.coalesce(F.lit(1.0) / (F.lit(float(CONCEPT_RRF_K)) + r[0]), F.lit(0.0)))
            met_first = F.when(r[0].isNotNull(), r[0]).otherwise(r[1] + 1000)
            return F.struct((-score).alias("neg"), met_first.alias("met"), concept.alias("concept"), score.alias("score"))

        names = F.array_distinct(F.transform(entries, lambda x: x["concept"]))
        return F.array_min(F.transform(names, one))

    return let(
        let(near, fuse),
        lambda b: F.when(b["score"] >= threshold, F.struct(b["concept"].alias("concept"), b["score"].alias("score"))),
    )


def _outcome(base: DataFrame, known: DataFrame, prefix: str) -> DataFrame:
    chosen = F.coalesce("strict_concept", "loose_concept")
    picked = base.withColumn("_concept", chosen)
    summaries = known.select(F.col("concept").alias("_concept"), F.col("summary").alias("_summary"))
    out = picked.join(summaries, "_concept", "left")
    is_new = F.col("_concept").isNull()
    return out.select(
        "ord",
        (~is_new).alias("matched"),
        F.coalesce("_concept", "name").alias("concept"),
        F.when(is_new, F.col("reason")).otherwise(F.col("_summary")).alias("summary"),
        F.coalesce("strict_score", "loose_score", F.lit(0.0)).alias("similarity"),
        is_new.alias("is_new"),
        wrap(F.coalesce("_concept", "name"), prefix).alias("link"),
        F.when(F.col("strict_concept").isNotNull(), F.lit("strict"))
        .when(F.col("loose_concept").isNotNull(), F.lit("loose"))
        .otherwise(F.lit("new"))
        .alias("match_kind"),
    )


# ------------------------------------------------------------- batch registration


#: Earlier neighbours listed per candidate in the first pass; each further pass lists four times as many.
NEIGHBOURS = 16
#: Edges that one task decides at a time.
TASK_EDGES = 2_000_000
#: Up to this many candidates are broadcast; more are placed in lists of about LIST_ROWS.
BROADCAST_CANDIDATES = 16_384
LIST_ROWS = 2048


def elect_leaders(candidates: DataFrame, threshold: float = STRICT_THRESHOLD, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Which candidates become new concepts when taken strictly in ``ord`` order.

    A candidate is a leader unless an earlier leader's name vector is within the threshold.

    One threshold join over lists around centres gives every candidate its few earliest
    neighbours before it: edges in proportion to the candidates, however large a group of near copies is.
    They decide nearly everyone, without another look at vectors: a listed leader makes a follower,
    and a complete list of followers makes a leader.  A candidate stays open if its list is full and holds
    followers only, or if it waits for an open one.  Open candidates are joined again, with longer
    lists, to leaders and open candidates only; the earliest is then decided whatever happens.
    Equal vectors are collapsed to their first occurrence before.
    """
    norm = F.aggregate("name_vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    flagged = candidates.select("ord", "name_vec", F.coalesce(norm > 0, F.lit(False)).alias("nonzero"))
    alone = flagged.filter(~F.col("nonzero")).select("ord")
    distinct = flagged.filter("nonzero").groupBy("name_vec").agg(F.min("ord").cast("bigint").alias("ord"))
    distinct = materialize(distinct.select("ord", F.col("name_vec").alias("vec")), "candidates")
    rows = distinct.count()
    lists = fit_lists(distinct, "vec", "ord", count=rows // LIST_ROWS) if rows > BROADCAST_CANDIDATES else None
    status = _decide(distinct, distinct, threshold, neighbours, lists)
    while not (still := status.filter("status = 'open'").select("ord")).isEmpty():
        neighbours *= 4
        rest = distinct.join(still, "ord", "left_semi")
        among = distinct.join(status.filter("status <> 'follower'").select("ord"), "ord", "left_semi")
        again = _decide(rest, among, threshold, neighbours, lists)
        before, status = status, materialize(status.filter("status <> 'open'").unionByName(again), "status")
        discard(before, again)
    return status.filter("status = 'leader'").select("ord").unionByName(alone)


def _edges(rows: DataFrame, among: DataFrame, threshold: float, neighbours: int, lists: Lists | None) -> DataFrame:
    """The earliest near rows before each row; without ``lists`` the few ``among`` are broadcast and rows stay in place."""
    others = among.select(F.col("ord").alias("other"), "vec")
    if lists is None:
        return materialize(earliest_near_few(rows, others, threshold, neighbours), "edges")
    stored = into_lists(others, "vec", lists)
    edges = materialize(earliest_near(rows, stored, threshold, neighbours, lists), "edges")
    discard(stored)
    return edges


def _decide(rows: DataFrame, among: DataFrame, threshold: float, neighbours: int, lists: Lists | None) -> DataFrame:
    """(ord, status) of every row: leader, follower or open; ``among`` are the rows and earlier leaders."""
    edges = _edges(rows, among, threshold, neighbours, lists)
    pieces = -(-edges.count() // TASK_EDGES)
    ends = edges.agg(F.percentile_approx("ord", [i / pieces for i in range(1, pieces)])).first()[0] if pieces > 1 else []
    bounds, decided = [None, *ends, None], None
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = edges
        if low is not None:
            part = part.filter(F.col("ord") > low)
        if high is not None:
            part = part.filter(F.col("ord") <= high)
        if decided is not None:
            part = part.join(decided.select(F.col("ord").alias("other"), "status"), "other", "left")
        else:
            part = part.withColumn("status", F.lit(None).cast("string"))
        part = part.select("ord", "other", "status").repartition(1).sortWithinPartitions("ord", "other")
        found = materialize(part.mapInArrow(_in_order(neighbours), "ord bigint, status string"), "decided")
        before, decided = decided, found if decided is None else materialize(decided.unionByName(found), "decided")
        if before is not None:
            discard(before, found)
    # a row without edges has nobody before it
    free = rows.select("ord").join(decided.select("ord"), "ord", "left_anti").withColumn("status", F.lit("leader"))
    result = materialize(decided.unionByName(free), "status")
    discard(edges, decided)
    return result


def _in_order(neighbours: int):
    """Decide rows of (ord, other, status of other) that come sorted; an unknown other has no edges and leads."""

    def run(batches):
        import pyarrow as pa

        own, status = None, {}
        seen = set()
        size = 0

        def close():
            if own is not None:
                status[own] = "follower" if "leader" in seen else "open" if "open" in seen or size >= neighbours else "leader"

        for batch in batches:
            for ord_, other, known in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ord_ != own:
                    close()
                    own, size = ord_, 0
                    seen.clear()
                seen.add(status.get(other) or known or "leader")
                size += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(list(status), pa.int64()), pa.array(list(status.values()), pa.string())], names=["ord", "status"])

    return run


def register_batch(
    incoming: DataFrame,
    registry: DataFrame,
    *,
    strict: float = STRICT_THRESHOLD,
    loose: float | None = LOOSE_THRESHOLD,
    prefix: str = DEFAULT_PREFIX,
    **knn_options,
) -> DataFrame:
    """Register a whole batch as if its items had been taken one by one.

    Order of decisions per item: best strict score over the snapshot and the
    concepts created earlier in the batch (ties: snapshot first, then earlier),
    else the loose match in the snapshot, else a new concept.  Vectors stay those
    of the first registration.  Adds ``created_by`` (ord of the creating item).
    """
    snapshot = materialize(
        register_or_match(incoming, registry, strict=strict, loose=loose, prefix=prefix, **knn_options), "snapshot"
    )
    fresh = incoming.join(snapshot.filter("is_new").select("ord"), "ord", "left_semi")
    leaders = elect_leaders(fresh, strict)
    created = materialize(
        incoming.join(leaders, "ord", "left_semi").select("ord", "name", "reason", "name_vec"), "created"
    )
    near = nearest(
        incoming,
        created.select(F.col("ord").alias("created_by"), "name_vec"),
        1,
        vectors=[("name", "name_vec", "name_vec")],
        query_key="ord",
        item_key="created_by",
        min_score=strict,
        query_order="ord",
        item_order="created_by",
        **knn_options,
    ).select("ord", "created_by", F.col("score").alias("new_score"))
    joined = (
        snapshot.join(near, "ord", "left")
        .join(
            created.select(
                F.col("ord").alias("created_by"), F.col("name").alias("new_name"), F.col("reason").alias("new_summary")
            ),
            "created_by",
            "left",
        )
    )
    strict_score = F.when(F.col("match_kind") == "strict", F.col("similarity"))
    use_new = F.col("new_score").isNotNull() & (strict_score.isNull() | (F.col("new_score") > strict_score))
    name = F.when(use_new, F.col("new_name")).otherwise(F.col("concept"))
    return joined.select(
        "ord",
        (use_new | F.col("matched")).alias("matched"),
        name.alias("concept"),
        F.when(use_new, F.col("new_summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(use_new, F.col("new_score")).otherwise(F.col("similarity")).alias("similarity"),
        (~use_new & F.col("is_new")).alias("is_new"),
        wrap(name, prefix).alias("link"),
        F.when(use_new, F.lit("strict")).otherwise(F.col("match_kind")).alias("match_kind"),
        F.when(use_new, F.col("created_by")).when(F.col("is_new"), F.col("ord")).alias("created_by"),
    )


# ------------------------------------------------------------- registry table


def upsert_concepts(
    registry: DataFrame, updates: DataFrame, now: Column, *, update_summary: bool = True
) -> DataFrame:
    """Merge (concept, summary, link, concept_vec, concept_summary_vec) rows.

    Existing: summary, link and last use change; count, first use and vectors
    stay.  New: count 1 and both stamps now.  At most one update per concept.
    """
    u = updates.select(
        "concept",
        F.col("summary").alias("_summary"),
        F.col("link").alias("_link"),
        F.col("concept_vec").alias("_cv"),
        F.col("concept_summary_vec").alias("_sv"),
        F.lit(True).alias("_hit"),
    )
    old = registry.withColumn("_old", F.lit(True))
    hit, known = F.col("_hit").isNotNull(), F.col("_old").isNotNull()
    summary = (F.when(hit, F.col("_summary")) if update_summary else F.when(hit & ~known, F.col("_summary")))
    return old.join(u, "concept", "full_outer").select(
        "concept",
        F.coalesce(summary, F.col("summary")).alias("summary"),
        F.coalesce(F.when(hit, F.col("_link")), F.col("link")).alias("link"),
        F.coalesce(F.col("note_count"), F.lit(1)).cast("bigint").alias("note_count"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(hit, now).otherwise(F.col("last_used_at")).alias("last_used_at"),
        F.coalesce("concept_vec", "_cv").alias("concept_vec"),
        F.coalesce("concept_summary_vec", "_sv").alias("concept_summary_vec"),
    )


def get_concepts(registry: DataFrame, names: DataFrame) -> DataFrame:
    """Exact-name lookup, payload only."""
    payload = registry.drop("concept_vec", "concept_summary_vec")
    return payload.join(names.select("concept").distinct(), "concept", "left_semi")


def touch_concepts(registry: DataFrame, uses: DataFrame, now: Column) -> DataFrame:
    """Add one per use by name; unknown names are ignored."""
    counts = uses.groupBy("concept").agg(F.count(F.lit(1)).alias("_n"))
    joined = registry.join(counts, "concept", "left")
    used = F.col("_n").isNotNull()
    return (
        joined.withColumn("note_count", F.col("note_count") + F.coalesce("_n", F.lit(0)))
        .withColumn("last_used_at", F.when(used, now).otherwise(F.col("last_used_at")))
        .select(*registry.columns)
    )


def scroll_concepts(registry: DataFrame, after: str | None = None, limit: int = PAGE_SIZE) -> DataFrame:
    """One page of payloads in name order, after the last name of the page before."""
    payload = registry.drop("concept_vec", "concept_summary_vec")
    if after is not None:
        payload = payload.filter(F.col("concept") > after)
    return payload.orderBy("concept").limit(limit)


class Pages(NamedTuple):
    """Payload rows stored in name order, each with its ``page``, and the first and last name of every page."""

    rows: DataFrame
    bounds: DataFrame


def store_pages(registry: DataFrame, limit: int = PAGE_SIZE) -> Pages:
    """Cut the registry into pages of ``limit`` concepts in name order, once, for any number of readers.

    One range partitioning sorts the names; counts of the ranges give every row its place, so no task holds
    more than a range.  Pages are numbered from 1.
    """
    payload = registry.drop("concept_vec", "concept_summary_vec")
    ordered = payload.repartitionByRange("concept").sortWithinPartitions("concept").withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(ordered, "pages")
    # a row's number holds its range and its place there; there are as many counts as ranges
    piece, place, first, starts = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1), 0, []
    for r in rows.groupBy(piece.alias("piece")).count().orderBy("piece").collect():
        starts.append((r["piece"], first))
        first += r["count"]
    begin = F.broadcast(registry.sparkSession.createDataFrame(starts, "_piece bigint, _first bigint"))
    page = F.floor((F.col("_first") + F.col("_place")) / limit) + 1
    numbered = rows.withColumns({"_piece": piece, "_place": place}).join(begin, "_piece").select(*payload.columns, page.alias("page"))
    bounds = numbered.groupBy("page").agg(F.min("concept").alias("first"), F.max("concept").alias("last"), F.count("*").alias("concepts"))
    return Pages(numbered, materialize(bounds, "page-bounds"))


def read_page(pages: Pages, page: int) -> DataFrame:
    """The concepts of one page, in name order; only files and row groups that its names lie in are read."""
    found = pages.bounds.filter(F.col("page") == page).first()
    if found is None:
        return pages.rows.limit(0)
    return pages.rows.filter(F.col("concept").between(found["first"], found["last"])).orderBy("concept")
