"""Concept curation, note state and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import metadata as meta
from quillmesh.operators import concepts as con
from quillmesh.operators import notes as state
from quillmesh.operators import registry as reg
from quillmesh.session import materialize
from workload import inputs as src
from workload import inputs_sql as sql

C = F.col
NOW = "2024-02-01 00:00:00"
NOW_ISO = "2024-02-01T00:00:00.000Z"


def now():
    return F.lit(NOW).cast("timestamp")


def listed(name):
    return F.array_join(name, "|").alias(name)


def stamps(*names):
    return [F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) for n in names]


def _state_out(df, *extra):
    return df.select(
        "note_path",
        F.when(C("me_concepts").isNotNull(), F.array_join("me_concepts", "|")).alias("me_concepts"),
        "me_indexed_at",
        *extra,
    )


# ------------------------------------------------------------- note state


def q_read_note_state(spark, d):
    """Fields parsed back out of notes that carry them in their frontmatter."""
    s = src.note_state(spark, d).drop("mtime").join(src.notes(spark, d).select("note_path", C("content").alias("body")), "note_path")
    items = F.array_join(F.transform("me_concepts", lambda x: F.concat(F.lit('  - "'), x, F.lit('"\n'))), "")
    listing = F.when(C("me_concepts").isNull(), "").when(F.size("me_concepts") == 0, "me_concepts: []\n").otherwise(
        F.concat(F.lit("me_concepts:\n"), items)
    )
    at = F.coalesce(F.concat(F.lit("me_indexed_at: "), "me_indexed_at", F.lit("\n")), F.lit(""))
    written = s.withColumn("content", F.concat(F.lit("---\ntitle: x\n"), listing, at, F.lit("---\n"), C("body")))
    return _state_out(state.read_state(written))


def q_needs_reindex(spark, d):
    return src.note_state(spark, d).select("note_path", state.needs_reindex().alias("needs_reindex"))


def q_indexed_after(spark, d):
    recent = state.indexed_within(src.note_state(spark, d), F.lit("2024-01-25 00:00:00Z").cast("timestamp"))
    return recent.select("note_path", "me_indexed_at")


def _with_new(spark, d):
    s = src.note_state(spark, d)
    return s.join(state.new_names(src.proposed_names(spark, d)), "note_path", "left")


def q_set_concepts(spark, d):
    return _state_out(state.set_concepts(_with_new(spark, d)))


def q_update_after_indexing(spark, d):
    return _state_out(state.update_after_indexing(_with_new(spark, d), F.lit(NOW_ISO), "pages"))


def q_set_indexed_at(spark, d):
    return _state_out(state.set_indexed_at(src.note_state(spark, d), F.lit(NOW_ISO)))


def q_clear_fields(spark, d):
    return _state_out(state.clear_fields(src.note_state(spark, d)), "cleared")


def q_clear_summary(spark, d):
    s = src.note_state(spark, d)
    cleared = state.clear_fields(s)
    return state.clear_summary(cleared, F.col("note_path").endswith("3.md"))


def q_all_concepts_distinct(spark, d):
    return con.all_concepts(src.note_state(spark, d))


def q_related_by_concept(spark, d):
    """Notes related to the note edited last (latest time, then path)."""
    s = src.note_state(spark, d)
    last = s.filter(F.size("me_concepts") > 0).orderBy(F.desc("mtime"), F.desc("note_path")).limit(1)
    r = con.related_by_concept(last, s)
    return r.select(
        "target_path", "note_path", F.array_join("shared", "|").alias("shared"),
        C("shared_count").cast("bigint").alias("shared_count"), C("rank").cast("bigint").alias("rank"),
    )


def q_batch_summary(spark, d):
    a = src.metadata_answers(src.notes(spark, d))
    m = meta.normalize_metadata(C("response"), C("content"))
    bad = F.when(F.try_parse_json(meta.strip_code_fence(C("response"))).isNull(), F.lit("no JSON"))
    runs = a.select("note_path", F.size(m["concepts"]).alias("n_concepts"), bad.alias("error"))
    return state.batch_summary(runs)


# ------------------------------------------------------------- concept rows


def _mentions(spark, d):
    """Concept mentions per note with clashing names, confidences and reasons."""
    i = src.incoming(spark, d)
    k = C("ord")
    name = F.when(k % 4 == 0, F.concat(F.lit("Idea "), (k % 3).cast("string"))).when(
        k % 4 == 1, F.concat(F.lit(" idea "), (k % 3).cast("string"), F.lit(" "))
    ).otherwise(F.concat(F.lit("IDEA "), (k % 3).cast("string")))
    reason = F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" why "), (k % 3).cast("string")))
    return i.select("ord", "note_path", name.alias("name"), (((k * 37) % 10) / F.lit(10.0)).alias("confidence"), reason.alias("reason"))


def q_dedup_concepts(spark, d):
    return con.dedup_concepts(_mentions(spark, d)).select("note_path", "first_ord", "name", "confidence", "reason")


def q_dedup_merge_reasons(spark, d):
    return con.dedup_merge_reasons(_mentions(spark, d)).select("note_path", "first_ord", "name", "confidence", "reason")


def q_concept_filter(spark, d):
    kept = con.filter_concepts(_mentions(spark, d), min_confidence=0.4, exclude=["IDEA 1", "Idea 2"], max_concepts=3)
    return kept.select("note_path", "ord", "name", "confidence", C("pick").cast("bigint").alias("pick"))


def tables(spark, d):
    """Incoming concepts and registry as stored tables, as a job would find them."""
    return materialize(src.incoming(spark, d), "incoming"), materialize(src.registry(spark, d), "registry")


def _resolved(spark, d):
    """The stored table of proposals that a review works on."""
    incoming, registry = tables(spark, d)
    return materialize(con.resolve_concepts(incoming, reg.register_or_match(incoming, registry)), "proposed")


def _resolved_out(df, *keys):
    info = C("match_info")
    return df.select(
        *keys, "note_path", "name", "confidence", "reason",
        info["original_term"].alias("original_term"), info["matched_concept"].alias("matched_concept"),
        info["match_type"].alias("match_type"), F.round(info["confidence"], 6).alias("match_confidence"),
    )


def q_resolve_concepts(spark, d):
    return _resolved_out(_resolved(spark, d), "ord")


def q_dedup_matches(spark, d):
    return _resolved_out(con.dedup_concepts(_resolved(spark, d), extra=["match_info"]), "first_ord")


def _selection(proposed):
    """Files and names ticked by the reviewer."""
    number = F.regexp_extract("note_path", r"doc_(\d+)", 1).cast("bigint")
    files = proposed.filter(number % 10 != 9).select("note_path")
    names = proposed.filter(C("ord") % 3 != 0).select("name")
    return files, names


def q_review_select(spark, d):
    p = _resolved(spark, d)
    return _resolved_out(con.review_select(p, *_selection(p)), "ord")


def q_review_reject(spark, d):
    p = _resolved(spark, d)
    return _resolved_out(con.review_reject(p, p.filter(C("ord") % 3 == 1)), "ord")


def q_concept_aliases(spark, d):
    return con.concept_aliases(_resolved(spark, d))


def q_concept_usage(spark, d):
    """Every event row is one use of a concept by a note."""
    e = src.table(spark, d, "events").select(
        F.concat("event_type", F.lit("/"), (C("user_id") % 5).cast("string")).alias("concept"),
        F.concat(F.lit("n/"), C("user_id").cast("string")).alias("note_path"),
        "ts",
    )
    u = con.concept_usage(e)
    text = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(n)
    return u.select("concept", "note_count", text("first_seen_at"), text("last_used_at"), "distinct_notes")


# ------------------------------------------------------------- registry


def _registry_out(df):
    return df.select("concept", "summary", "link", "note_count", *stamps("first_seen_at", "last_used_at"))


def q_strict_match(spark, d):
    m = reg.strict_match(src.incoming(spark, d), src.registry(spark, d), limit=3)
    return m.select("ord", "concept", F.round("score", 6).alias("score"), C("rank").cast("bigint").alias("rank"))


def q_loose_match(spark, d):
    m = reg.loose_match(src.incoming(spark, d), src.registry(spark, d))
    return m.select("ord", "concept", F.round("score", 6).alias("score"), C("rank").cast("bigint").alias("rank"))


def q_register_or_match(spark, d):
    return reg.register_or_match(*tables(spark, d)).select(
        "ord", "matched", "concept", "summary", F.round("similarity", 6).alias("similarity"), "is_new", "link", "match_kind"
    )


def q_register_batch(spark, d):
    r = reg.register_batch(*tables(spark, d))
    return r.select("ord", "matched", "concept", "summary", F.round("similarity", 6).alias("similarity"), "is_new", "link", "created_by")


def _updates(spark, d):
    """Half known, half unseen concepts."""
    r = src.registry(spark, d)
    number = F.regexp_extract("concept", r"_(\d+)", 1).cast("bigint")
    return r.select(
        F.when(number % 2 == 0, C("concept")).otherwise(F.concat(F.lit("Fresh_"), number.cast("string"))).alias("concept"),
        F.concat(F.lit("now "), number.cast("string")).alias("summary"),
        F.concat(F.lit("[[pages/"), number.cast("string"), F.lit("]]")).alias("link"),
        C("concept_summary_vec").alias("concept_vec"),
        C("concept_vec").alias("concept_summary_vec"),
    )


def q_concept_upsert(spark, d):
    merged = reg.upsert_concepts(src.registry(spark, d), _updates(spark, d), now())
    first = F.round(F.element_at("concept_vec", 1).cast("double"), 6).alias("vec_head")
    return merged.select("concept", "summary", "link", "note_count", *stamps("first_seen_at", "last_used_at"), first)


def q_concept_get(spark, d):
    return _registry_out(reg.get_concepts(src.registry(spark, d), _updates(spark, d)))


def q_concept_touch(spark, d):
    uses = src.note_state(spark, d).select(F.explode("me_concepts").alias("link")).select(
        F.regexp_extract("link", r"/(.+)\]\]", 1).alias("concept")
    )
    return _registry_out(reg.touch_concepts(src.registry(spark, d), uses, now()))


def q_scroll_concepts(spark, d):
    """Second page of the registry."""
    r = src.registry(spark, d)
    last = reg.scroll_concepts(r).agg(F.max("concept")).first()[0]
    return _registry_out(reg.scroll_concepts(r, after=last))


def q_scroll_pages(spark, d):
    """The whole registry with the page of every concept."""
    pages = reg.store_pages(src.registry(spark, d))
    return pages.rows.select("page", "concept", "summary", "note_count")


def q_related_top(spark, d):
    """The three closest notes of every note by shared links."""
    s = src.note_state(spark, d)
    r = con.related_by_concept(s, s, limit=3)
    return r.select(
        "target_path", "note_path", F.array_join("shared", "|").alias("shared"),
        C("shared_count").cast("bigint").alias("shared_count"), C("rank").cast("bigint").alias("rank"),
    )


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_") and callable(v)}

# ---------------------------------------------------------------- SQL

_STATE = sql.with_(sql.NOTE_STATE, sql.STAMPS)
_NEW = sql.with_(
    sql.NOTE_STATE,
    sql.PROPOSED,
    """fresh as (
  select note_path, list(name order by o) as new_names from (
    select note_path, name, min(ord) as o from proposed group by note_path, name) group by note_path),
old as (
  select note_path, unnest(me_concepts) as link, generate_subscripts(me_concepts, 1) as k from note_state where me_concepts is not null),
all_names as (
  select note_path, case when regexp_matches(link, '\\[\\[.+/(.+)\\]\\]$') then regexp_extract(link, '\\[\\[.+/(.+)\\]\\]$', 1) else link end as name, k from old
  union all
  select note_path, unnest(new_names), 1000 + generate_subscripts(new_names, 1) from fresh),
once as (select note_path, name, min(k) as k from all_names group by note_path, name)""",
)
_MENTIONS = sql.with_(
    sql.EMB,
    sql.INCOMING,
    """mentions as (
  select ord, note_path,
    case ord % 4 when 0 then 'Idea ' || (ord % 3) when 1 then ' idea ' || (ord % 3) || ' ' else 'IDEA ' || (ord % 3) end as name,
    ((ord * 37) % 10) / 10.0::double as confidence,
    case when ord % 5 = 0 then null else ' why ' || (ord % 3) end as reason
  from incoming)""",
)
_FOLD = """seq as (
  select note_path, lower(trim(name)) as key, row_number() over (partition by note_path, lower(trim(name)) order by ord) as k,
    ord, name, confidence, reason, trim(coalesce(reason, '')) as t from mentions),
fold(note_path, key, k, first_ord, name, confidence, reason) as (
  select note_path, key, k, ord, name, confidence, reason from seq where k = 1
  union all
  select f.note_path, f.key, s.k, f.first_ord,
    case when s.confidence > f.confidence then s.name else f.name end,
    greatest(s.confidence, f.confidence),
    case when trim(coalesce(f.reason, '')) = '' then s.t when s.t = '' or s.t = trim(f.reason) then trim(f.reason) else trim(f.reason) || '; ' || s.t end
  from fold f join seq s on s.note_path = f.note_path and s.key = f.key and s.k = f.k + 1)"""

_MATCH = """sims as (
  select i.ord, r.concept, r.summary, round(list_cosine_similarity(i.name_vec, r.concept_vec), 9) as s,
    round(list_cosine_similarity(i.reason_vec, r.concept_summary_vec), 9) as z
  from incoming i, registry r),
by_name as (select *, row_number() over (partition by ord order by s desc, concept) as rank from sims qualify rank <= 3),
by_reason as (select *, row_number() over (partition by ord order by z desc, concept) as rank from sims qualify rank <= 2),
loose_scores as (
  select ord, concept, coalesce(1.0::double / (1 + max(rn)), 0) + coalesce(1.0::double / (1 + max(rz)), 0) as score from (
    select ord, concept, rank as rn, null::bigint as rz from by_name where rank <= 2
    union all select ord, concept, null, rank from by_reason)
  group by ord, concept),
loose as (
  select ord, concept, score, row_number() over (partition by ord order by score desc, concept) as rank from loose_scores
  where score >= 0.85 qualify rank = 1),
matches as (
  select i.ord, i.name, i.reason, st.concept as sc, st.s as ss, lo.concept as lc, lo.score as ls
  from incoming i left join by_name st on st.ord = i.ord and st.rank = 1 and st.s >= 0.9 left join loose lo on lo.ord = i.ord),
outcome as (
  select m.ord, coalesce(sc, lc) is not null as matched, coalesce(sc, lc, m.name) as concept,
    case when coalesce(sc, lc) is null then m.reason else r.summary end as summary,
    coalesce(case when sc is not null then ss else ls end, 0)::double as similarity, coalesce(sc, lc) is null as is_new,
    '[[_me/' || coalesce(sc, lc, m.name) || ']]' as link,
    case when sc is not null then 'strict' when lc is not null then 'loose' else 'new' end as match_kind
  from matches m left join registry r on r.concept = coalesce(sc, lc)),
resolved as (
  select i.ord, i.note_path, o.concept as name, i.confidence, i.reason, i.name as original_term, o.concept as matched_concept,
    case when o.is_new then 'new' else 'alias' end as match_type, round(o.similarity, 6) as match_confidence
  from incoming i join outcome o using (ord))"""
_MATCHED = sql.with_(sql.EMB, sql.REGISTRY, sql.INCOMING, _MATCH)

# Sequential registration: candidates in order, a candidate leads unless an earlier leader is near.
_BATCH = """cand as materialized (select i.ord, i.name_vec, row_number() over (order by i.ord) as idx from incoming i join outcome o using (ord) where o.is_new),
near_earlier as materialized (
  select a.idx, list(b.ord) as earlier from cand a join cand b on b.ord < a.ord
  where round(list_cosine_similarity(a.name_vec, b.name_vec), 9) >= 0.9 group by a.idx),
ballots as materialized (select c.idx, c.ord, coalesce(n.earlier, []) as earlier from cand c left join near_earlier n using (idx)),
elect(idx, leaders) as (
  select 0::bigint, []::bigint[]
  union all
  select e.idx + 1, case when list_has_any(b.earlier, e.leaders) then e.leaders else list_append(e.leaders, b.ord) end
  from elect e join ballots b on b.idx = e.idx + 1),
leader_ids as (select unnest(leaders) as ord from elect where idx = (select max(idx) from elect)),
leaders as materialized (select i.ord as created_by, i.name as new_name, i.reason as new_summary, i.name_vec from incoming i join leader_ids using (ord)),
near_new as (
  select i.ord, l.created_by, l.new_name, l.new_summary, round(list_cosine_similarity(i.name_vec, l.name_vec), 9) as new_score
  from incoming i join leaders l on l.created_by < i.ord
  where round(list_cosine_similarity(i.name_vec, l.name_vec), 9) >= 0.9
  qualify row_number() over (partition by i.ord order by new_score desc, l.created_by) = 1),
batch as (
  select o.ord, use_new or o.matched as matched, case when use_new then new_name else o.concept end as concept,
    case when use_new then new_summary else o.summary end as summary,
    round(case when use_new then new_score else o.similarity end, 6) as similarity, not use_new and o.is_new as is_new,
    '[[_me/' || case when use_new then new_name else o.concept end || ']]' as link,
    case when use_new then created_by when o.is_new then o.ord end as created_by
  from (
    select o.*, n.created_by, n.new_name, n.new_summary, n.new_score,
      n.new_score is not null and (o.match_kind <> 'strict' or n.new_score > o.similarity) as use_new
    from outcome o left join near_new n using (ord)) o)"""
BATCHED = sql.with_(sql.EMB, sql.REGISTRY, sql.INCOMING, _MATCH, _BATCH, recursive=True)
# The same over the confirmed rows: the matched name takes the known concept's vector.
APPLIED = sql.with_(
    sql.EMB,
    sql.REGISTRY,
    sql.INCOMING.replace("incoming as (", "extracted as (", 1),
    *[
        _MATCH.replace("from incoming i", "from extracted i")
        .replace("sims as", "sims0 as").replace("from sims ", "from sims0 ").replace("by_name", "by_name0").replace("by_reason", "by_reason0")
        .replace("loose_scores", "loose_scores0").replace("loose as", "loose0 as").replace("join loose lo", "join loose0 lo")
        .replace("matches", "matches0").replace("outcome", "outcome0")
    ],
    """incoming as (
  select r.ord, r.note_path, r.matched_concept as name, r.reason, coalesce(k.concept_vec, x.name_vec) as name_vec, x.reason_vec, x.confidence
  from resolved r join extracted x using (ord) left join registry k on k.concept = r.matched_concept
  where regexp_extract(r.note_path, 'doc_(\\d+)', 1)::bigint % 10 <> 9 and r.name in (select name from resolved where ord % 3 <> 0))""",
    _MATCH[: _MATCH.index(",\nresolved as")],
    _BATCH,
    recursive=True,
)
_REG = sql.with_(sql.EMB, sql.REGISTRY)
_UPD = """updates as (
  select case when n % 2 = 0 then concept else 'Fresh_' || n end as concept, 'now ' || n as summary, '[[pages/' || n || ']]' as link,
    concept_summary_vec as concept_vec from (select *, regexp_extract(concept, '_(\\d+)', 1)::bigint as n from registry))"""


def _fmt(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


_REG_COLS = f"concept, summary, link, note_count, {_fmt('first_seen_at')} as first_seen_at, {_fmt('last_used_at')} as last_used_at"
_ST = "note_path, array_to_string(me_concepts, '|') as me_concepts, me_indexed_at"

SQL = {
    "read_note_state": sql.with_(sql.NOTE_STATE) + f"select {_ST} from note_state",
    "needs_reindex": _STATE
    + "select note_path, me_indexed_at is null or me_indexed_at = '' or coalesce(mtime > stamped, false) as needs_reindex from stamps",
    "indexed_after": _STATE + "select note_path, me_indexed_at from stamps where stamped > timestamp '2024-01-18 00:00:00'",
    "set_concepts": _NEW
    + """select s.note_path, case when f.new_names is null then array_to_string(s.me_concepts, '|') else o.links end as me_concepts, s.me_indexed_at
from note_state s left join fresh f using (note_path) left join (
  select note_path, string_agg('[[_me/' || name || ']]', '|' order by k) as links from once group by note_path) o using (note_path)""",
    "update_after_indexing": _NEW
    + f"""select s.note_path, coalesce(o.links, '') as me_concepts, '{NOW_ISO}' as me_indexed_at
from note_state s left join (
  select note_path, string_agg('[[pages/' || name || ']]', '|' order by k) as links from once group by note_path) o using (note_path)""",
    "set_indexed_at": sql.with_(sql.NOTE_STATE)
    + f"select note_path, array_to_string(me_concepts, '|') as me_concepts, '{NOW_ISO}' as me_indexed_at from note_state",
    "clear_fields": sql.with_(sql.NOTE_STATE)
    + f"""select note_path, case when hit then null else array_to_string(me_concepts, '|') end as me_concepts,
  case when hit then null else me_indexed_at end as me_indexed_at, hit as cleared
from (select *, me_concepts is not null or coalesce(me_indexed_at, '') <> '' as hit from note_state)""",
    "clear_summary": sql.with_(sql.NOTE_STATE)
    + """select count(*) filter (where hit and not bad) as cleared, count(*) filter (where hit and bad) as failed
from (select me_concepts is not null or coalesce(me_indexed_at, '') <> '' as hit, note_path like '%3.md' as bad from note_state)""",
    "all_concepts_distinct": sql.with_(sql.NOTE_STATE)
    + """select distinct regexp_extract(link, '\\[\\[.*/(.+)\\]\\]', 1) as concept
from (select unnest(me_concepts) as link from note_state) where regexp_matches(link, '\\[\\[.*/(.+)\\]\\]')""",
    "related_by_concept": sql.with_(sql.NOTE_STATE)
    + """, target as (select note_path, me_concepts from note_state where len(me_concepts) > 0 order by mtime desc, note_path desc limit 1)
select target_path, note_path, array_to_string(shared, '|') as shared, len(shared) as shared_count,
  row_number() over (order by len(shared) desc, note_path) as rank
from (select t.note_path as target_path, s.note_path, list_filter(s.me_concepts, lambda c: list_contains(t.me_concepts, c)) as shared
      from note_state s, target t where s.note_path <> t.note_path and s.me_concepts is not null)
where len(shared) > 0""",
    "dedup_concepts": _MENTIONS
    + """select note_path, first_ord, name, confidence, reason from (
  select *, min(ord) over (partition by note_path, lower(name)) as first_ord,
    row_number() over (partition by note_path, lower(name) order by confidence desc, ord) as rn from mentions) where rn = 1""",
    "dedup_merge_reasons": _MENTIONS.replace("with ", "with recursive ", 1)
    + ","
    + _FOLD
    + "select note_path, first_ord, name, confidence, reason from fold f where k = (select max(k) from seq s where s.note_path = f.note_path and s.key = f.key)",
    "concept_filter": _MENTIONS
    + """select * from (
  select note_path, ord, name, confidence, row_number() over (partition by note_path order by confidence desc, ord) as pick from mentions
  where confidence >= 0.4 and name not in ('IDEA 1', 'Idea 2')) where pick <= 3""",
    "resolve_concepts": _MATCHED + "select * from resolved",
    "dedup_matches": _MATCHED
    + """select first_ord, note_path, name, confidence, reason, original_term, matched_concept, match_type, match_confidence from (
  select *, min(ord) over (partition by note_path, lower(name)) as first_ord,
    row_number() over (partition by note_path, lower(name) order by confidence desc, ord) as rn from resolved) where rn = 1""",
    "review_select": _MATCHED
    + """select * from resolved where regexp_extract(note_path, 'doc_(\\d+)', 1)::bigint % 10 <> 9
and name in (select name from resolved where ord % 3 <> 0)""",
    "review_reject": _MATCHED
    + "select * from resolved r where not exists (select 1 from resolved x where x.ord % 3 = 1 and x.note_path = r.note_path and x.name = r.name)",
    "concept_aliases": _MATCHED + "select distinct original_term as alias, matched_concept as concept from resolved where match_type = 'alias'",
    "concept_usage": """select event_type || '/' || (user_id % 5) as concept, count(*) as note_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as first_seen_at,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last_used_at, count(distinct user_id) as distinct_notes from events group by 1""",
    "strict_match": _MATCHED + "select ord, concept, round(s, 6) as score, rank from by_name where s >= 0.9",
    "loose_match": _MATCHED + "select ord, concept, round(score, 6) as score, rank from loose",
    "register_or_match": _MATCHED
    + "select ord, matched, concept, summary, round(similarity, 6) as similarity, is_new, link, match_kind from outcome",
    "register_batch": BATCHED + "select * from batch",
    "concept_upsert": sql.with_(sql.EMB, sql.REGISTRY, _UPD)
    + f"""select coalesce(r.concept, u.concept) as concept, coalesce(u.summary, r.summary) as summary, coalesce(u.link, r.link) as link,
  coalesce(r.note_count, 1) as note_count, {_fmt(f"coalesce(r.first_seen_at, timestamp '{NOW}')")} as first_seen_at,
  {_fmt(f"case when u.concept is not null then timestamp '{NOW}' else r.last_used_at end")} as last_used_at,
  round(coalesce(r.concept_vec, u.concept_vec)[1], 6) as vec_head
from registry r full join updates u on u.concept = r.concept""",
    "concept_get": sql.with_(sql.EMB, sql.REGISTRY, _UPD)
    + f"select {_REG_COLS} from registry where concept in (select concept from updates)",
    "concept_touch": sql.with_(sql.EMB, sql.REGISTRY, sql.NOTE_STATE)
    + f"""select concept, summary, link, note_count + coalesce(n, 0) as note_count, {_fmt('first_seen_at')} as first_seen_at,
  {_fmt(f"case when n is not null then timestamp '{NOW}' else last_used_at end")} as last_used_at
from registry left join (
  select regexp_extract(link, '/(.+)\\]\\]', 1) as concept, count(*) as n from (select unnest(me_concepts) as link from note_state) group by 1) using (concept)""",
    "scroll_pages": _REG + "select (row_number() over (order by concept) - 1) // 100 + 1 as page, concept, summary, note_count from registry",
    "related_top": sql.with_(sql.NOTE_STATE)
    + """, pairs as (
  select t.note_path as target_path, s.note_path, list_filter(s.me_concepts, lambda c: list_contains(t.me_concepts, c)) as shared
  from note_state s join note_state t on s.note_path <> t.note_path
  where list_has_any(s.me_concepts, t.me_concepts))
select target_path, note_path, array_to_string(shared, '|') as shared, len(shared) as shared_count,
  row_number() over (partition by target_path order by len(shared) desc, note_path) as rank
from pairs qualify rank <= 3""",
    "scroll_concepts": _REG + f"select {_REG_COLS} from registry order by concept limit 100 offset 100",
    "batch_summary": sql.with_(sql.NOTES, sql.ANSWERS)
    + """select count(*) as files_total, count(*) filter (where ok) as files_processed, count(*) filter (where not ok) as files_failed,
  sum(n)::bigint as concepts_total, floor(count(*) filter (where ok) * 100.0::double / count(*) + 0.5::double)::bigint as percent
from (select doc_id % 8 <> 2 as ok, case doc_id % 8 when 0 then 2 when 1 then 2 when 5 then 2 when 6 then 3 else 0 end as n from answers)""",
}
