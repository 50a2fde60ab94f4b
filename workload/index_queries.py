"""Index lifecycle, queues, streams and whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmesh.functions.vectors import hash_embedding
from quillmesh.operators import chunking
from quillmesh.operators import registry as reg
from quillmesh.operators.concepts import resolve_concepts, review_select
from quillmesh.plans import indexing, review
from quillmesh.session import fresh_path, materialize, path_exists
from quillmesh.sources import bucketed_log, vault
from quillmesh.sources import index_store as store
from quillmesh.sources import notes as note_source
from quillmesh.streaming import ambient, paragraphs, refresh, sink
from workload import concept_queries as cq
from workload import inputs as src
from workload import inputs_sql as sql
from workload import text_queries as tq
from workload import vector_queries as vq

C = F.col
NOW_MS = 1706745600000
MAX = chunking.INDEX_CHUNK_CHARS


def _head(name="content_vec"):
    return F.round(F.element_at(name, 1).cast("double"), 6).alias("vec_head")


def _index(spark, d):
    return src.chunk_index(spark, d).drop("vec_id")


def _index_out(df, *extra):
    return df.select("chunk_id", "file_path", "summary", F.array_join("tags", "|").alias("tags"), _head(), *extra)


def _update(spark, d):
    """New versions of every chunk whose file number is even, and one new chunk per file."""
    i = _index(spark, d)
    even = F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint") % 2 == 0
    changed = i.filter(even).withColumn("summary", F.concat(F.lit("v2 "), "content")).withColumn("content_vec", C("title_vec"))
    added = i.filter(C("chunk_id").endswith("-chunk-0")).withColumn("chunk_id", F.concat("file_path", F.lit("-chunk-9")))
    return changed.unionByName(added)


def q_index_upsert(spark, d):
    return _index_out(store.upsert(_index(spark, d), _update(spark, d)))


def q_index_delete_id(spark, d):
    i = _index(spark, d)
    gone = i.filter(C("header_path") != "").select("chunk_id")
    log = store.as_upserts(i, F.lit(0)).unionByName(store.as_tombstones(i, gone, F.lit(1)))
    return _index_out(store.current_view(log))


def q_index_delete_file(spark, d):
    i = _index(spark, d)
    files = i.filter(C("summary") == "").groupBy("file_path").count().filter(C("count") >= 2)
    return _index_out(store.delete_files(i, files))


def q_index_count(spark, d):
    return store.count_points(_index(spark, d), src.registry(spark, d))


def q_index_clear(spark, d):
    """A stored index is counted, cleared and counted again."""
    path, rows = fresh_path(spark, "cleared"), _index(spark, d)
    store.write_batch(store.as_upserts(rows, F.lit(0)), f"{path}/run=0", 0)
    before = store.count_points(sink.stored_rows(spark, path)).first()["points"]
    sink.clear(spark, path)
    after = sink.stored_rows(spark, path).count() if path_exists(spark, path) else 0
    return spark.createDataFrame([(before, after)], "points_before bigint, points_after bigint")


def q_index_stats(spark, d):
    return store.index_stats(_index(spark, d))


def q_legacy_expand(spark, d):
    flat = store.legacy_view(_index(spark, d))
    i = store.legacy_expand(flat)
    return i.select("chunk_id", *[F.round(F.element_at(v, 1).cast("double"), 6).alias(v) for v in store.VECTORS])


def _pending(spark, d):
    """Queue writes: two writes per chunk id for most ids, the later one wins."""
    i = src.chunk_index(spark, d)
    again = i.filter(C("vec_id") % 3 != 0).withColumn("summary", F.concat(F.lit("late "), "content"))
    seq = F.when(C("summary").startswith("late "), C("vec_id") + 1000000).otherwise(C("vec_id"))
    return i.unionByName(again).withColumn("seq", seq).select("chunk_id", "file_path", "summary", "tags", "content_vec", "seq")


def _busy_files(pending):
    return pending.groupBy("file_path").count().filter(C("count") >= 9).select("file_path")


def q_queue_by_file(spark, d):
    p = store.latest_pending(_pending(spark, d))
    return _index_out(store.pending_of_files(p, _busy_files(_pending(spark, d))), "seq")


def q_queue_drop_file(spark, d):
    p = store.latest_pending(_pending(spark, d))
    return _index_out(store.drop_pending_of_files(p, _busy_files(_pending(spark, d))), "seq")


def _drained(spark, d):
    """Stream the first and then the late queue writes through the sink; the log."""
    source, path, checkpoint = (fresh_path(spark, n) for n in ("pending", "log", "ckpt"))
    rows = _pending(spark, d)
    late = C("summary").startswith("late ")
    for part in (rows.filter(~late), rows.filter(late)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        sink.start_sink(stream, path, checkpoint, interval=None).awaitTermination()
    return path


def q_micro_batch_sink(spark, d):
    return _index_out(sink.stored_rows(spark, _drained(spark, d)))


def q_sink_stats(spark, d):
    return sink.sink_stats(spark, _drained(spark, d))


# ------------------------------------------------------------- jobs


def q_incremental_index(spark, d):
    """Old index of one placeholder per note; stale notes are chunked again, some of them edited to blank."""
    notes, state = src.notes(spark, d), src.note_state(spark, d)
    old = notes.select(
        chunking.chunk_id(C("note_path"), F.lit(0)).alias("chunk_id"),
        C("note_path").alias("file_path"),
        F.lit("old").alias("content"),
        F.lit(3).cast("bigint").alias("word_count"),
    )
    edited = notes.withColumn("content", F.when(C("doc_id") % 17 == 3, F.lit(" \n")).otherwise(C("content")))
    stale = indexing.stale_notes(edited, state)
    fresh = chunking.chunk_notes(stale, MAX).select(
        chunking.chunk_id(C("note_path"), C("index")).alias("chunk_id"),
        C("note_path").alias("file_path"),
        "content",
        F.length("content").cast("bigint").alias("word_count"),
    )
    return indexing.refresh_index(old, fresh, stale)


def q_incremental_stream(spark, d):
    """All notes, then edits, blanked notes, deletions and late versions, streamed in two starts; the index left."""
    source, path, checkpoint = (fresh_path(spark, n) for n in ("versions", "log", "ckpt"))
    first = src.notes(spark, d).select("doc_id", "note_path", "content", F.lit(1).alias("version"))
    doc = C("doc_id")
    text = (
        F.when(doc % 11 == 5, F.lit(None))
        .when(doc % 17 == 4, F.lit(" \n"))
        .when(doc % 7 == 3, F.concat("content", F.lit("\n\n# Added\ntext of "), doc.cast("string")))
    )
    edits = first.filter((doc % 11 == 5) | (doc % 17 == 4) | (doc % 7 == 3)).withColumns({"content": text, "version": F.lit(2)})
    late = first.filter(doc % 13 == 2).withColumns({"content": F.lit("too late"), "version": F.lit(0)})
    for part in (first, edits.unionByName(late)):
        part.drop("doc_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema("note_path string, content string, version int").parquet(source)
        refresh.start_refresh(stream, path, checkpoint, max_chars=MAX, interval=None).awaitTermination()
    rows = sink.stored_rows(spark, path)
    return rows.select("chunk_id", "file_path", "content", "header_path", *[C(c).cast("bigint").alias(c) for c in ("start_pos", "end_line")])


def q_vault_roundtrip(spark, d):
    """Notes written as files by tasks, some of them empty, and read back as a folder."""
    root = fresh_path(spark, "vault")
    n = src.notes(spark, d)
    vault.write_notes(n.withColumn("content", F.when(C("doc_id") % 10 != 9, C("content")).otherwise("")), root)
    return note_source.read_vault(spark, root).select("note_path", "title", "content")


def q_bucketed_log(spark, d):
    """Upserts, tombstones and more upserts in a bucketed log, compacted; its current rows."""
    i = _index(spark, d).drop("summary_vec", "title_vec")
    name = f"log_{uuid.uuid4().hex}"
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in i.schema.fields)
    bucketed_log.open_log(spark, name, fresh_path(spark, "bucketed"), f"{ddl}, version bigint, deleted boolean", 8)
    bucketed_log.append_upserts(i, name, F.lit(0))
    bucketed_log.append_tombstones(i.filter(C("header_path") != ""), name, F.lit(1))
    bucketed_log.append_upserts(_update(spark, d).drop("summary_vec", "title_vec"), name, F.lit(2))
    bucketed_log.compact(spark, name, F.lit(3))
    return _index_out(bucketed_log.current(spark, name))


def _embedder(dim=vq.DIM):
    """Word-hash vectors as a plain callable, standing in for a model."""

    def embed(texts):
        import hashlib

        out = []
        for text in texts:
            counts = [0.0] * dim
            for word in text.lower().replace("\n", " ").split(" "):
                if word:
                    counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim] += 1.0
            norm = sum(c * c for c in counts) ** 0.5
            out.append([c / norm if norm else 0.0 for c in counts])
        return out

    return embed


def answers_per_chunk(notes):
    """The note's answer for every chunk number it can possibly have."""
    most = F.size(F.split("content", "\n", -1)) + F.floor(F.length("content") / MAX).cast("int")
    a = src.metadata_answers(notes)
    return a.select("note_path", "response", F.explode(F.sequence(F.lit(0), most)).alias("index"))


def _unified(spark, d):
    notes = src.notes(spark, d)
    spans = src.span_answers(notes).select("note_path", "response")
    indexes = answers_per_chunk(notes)
    return indexing.unified_index(notes, spans, indexes, _embedder(), F.lit(NOW_MS).cast("bigint"), MAX)


def q_unified_index(spark, d):
    rows = _unified(spark, d).rows
    heads = [F.round(F.element_at(v, 3).cast("double"), 6).alias(v) for v in store.VECTORS]
    return rows.select("chunk_id", "file_path", "header_path", "summary", F.array_join("tags", "|").alias("tags"),
                       F.array_join("concepts", "|").alias("concepts"), C("word_count").cast("bigint").alias("word_count"),
                       "indexed_at", *heads)


def q_index_totals(spark, d):
    """Totals of the span path, taken while its rows were written."""
    t = _unified(spark, d).totals
    return spark.createDataFrame([tuple(t.values())], ", ".join(f"{k} bigint" for k in t))


def _applied(spark, d):
    """Reviewer's choice applied to the notes of the incoming concepts."""
    incoming, registry = cq.tables(spark, d)
    matches = reg.register_or_match(incoming, registry)
    proposed = materialize(resolve_concepts(incoming, matches), "proposed")
    chosen = review_select(proposed, *cq._selection(proposed))
    own = incoming.select("ord", "name_vec", "reason_vec")
    known = registry.select(C("concept").alias("matched"), C("concept_vec").cast("array<double>").alias("known_vec"))
    selected = (
        chosen.withColumn("matched", C("match_info.matched_concept"))
        .join(own, "ord")
        .join(known, "matched", "left")
        .withColumn("name_vec", F.coalesce("known_vec", "name_vec"))
        .select("ord", "note_path", "reason", "match_info", "name_vec", "reason_vec")
    )
    state = incoming.select("note_path").distinct().select(
        "note_path", F.array(F.lit("[[_me/Kept]]")).alias("me_concepts"), F.lit(None).cast("string").alias("me_indexed_at")
    )
    return review.apply_concepts(selected, registry, state, cq.now(), F.lit(cq.NOW_ISO))


def q_apply_registry(spark, d):
    r = _applied(spark, d).registry
    return r.select("concept", "note_count", (C("last_used_at") == cq.now()).alias("used_now"))


def q_apply_usage(spark, d):
    return _applied(spark, d).usage.select("concept", "note_count", "distinct_notes")


def q_apply_concepts(spark, d):
    applied = _applied(spark, d)
    return applied.note_state.select("note_path", F.array_join("me_concepts", "|").alias("me_concepts"), "me_indexed_at")


# ------------------------------------------------------------- streams


def q_paragraph_extract(spark, d):
    p = paragraphs.extract_paragraphs(src.editor_events(spark, d))
    return p.select("editor_id", "turn", C("cursor").cast("bigint").alias("cursor"), "paragraph", C("char_count").cast("bigint").alias("char_count"))


def q_paragraph_debounce(spark, d):
    p = paragraphs.debounce(src.editor_events(spark, d))
    return p.select("editor_id", "turn", C("cursor").cast("bigint").alias("cursor"), "paragraph", C("char_count").cast("bigint").alias("char_count"))


def q_ambient_recommend(spark, d):
    """Editor changes streamed in two steps, recommendations from the documents."""
    source, path, checkpoint = (fresh_path(spark, n) for n in ("editor", "recs", "ckpt"))
    events = src.editor_events(spark, d).drop("turn")
    events.write.mode("append").parquet(source)
    tick = events.groupBy().agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("bigint").alias("editor_id"), (C("ts") + F.expr("interval 1 hour")).alias("ts"),
        F.lit("").alias("content"), F.lit(0).alias("cursor"),
    )
    index = vq._text_index(spark, d)
    embed = lambda text: hash_embedding(text, vq.DIM)
    stored = fresh_path(spark, "index")
    index.write.parquet(stored)

    def run():
        stream = spark.readStream.schema(events.schema).parquet(source)
        ambient.start_recommender(stream, lambda: spark.read.parquet(stored), embed, path, checkpoint).awaitTermination()

    run()
    tick.write.mode("append").parquet(source)
    run()
    recs = spark.read.parquet(f"{path}/recommendations")
    return recs.select("query_id", C("rank").cast("bigint").alias("rank"), "note_path", "title", F.round("similarity", 6).alias("similarity"), "excerpt")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_") and callable(v)}

# ---------------------------------------------------------------- SQL

_IDX = sql.with_(sql.EMB, sql.CHUNK_INDEX)
_COLS = "chunk_id, file_path, summary, array_to_string(tags, '|') as tags, round(content_vec[1], 6) as vec_head"
_EVEN = "regexp_extract(file_path, '(\\d+)', 1)::bigint % 2 = 0"
_PEND = sql.with_(
    sql.EMB,
    sql.CHUNK_INDEX,
    """pending as (
  select chunk_id, file_path, summary, tags, content_vec, vec_id as seq from chunk_index
  union all
  select chunk_id, file_path, 'late ' || content, tags, content_vec, vec_id + 1000000 from chunk_index where vec_id % 3 <> 0),
latest as (select * from pending qualify row_number() over (partition by chunk_id order by seq desc) = 1),
busy as (select file_path from pending group by file_path having count(*) >= 9)""",
)
_EV = sql.with_(
    sql.EVENTS,
    f"""judged as (
  select *, case when cursor >= 2 and substr(content, cursor - 1, 2) = {sql.NL} || {sql.NL}
    then {sql.trim(f"str_split(substr(content, 1, cursor - 2), {sql.NL} || {sql.NL})[-1]")} end as paragraph,
    lead(ts) over (partition by editor_id order by ts) as next_ts
  from events_in),
found as (select *, length(paragraph) as char_count from judged where paragraph <> '' and length(paragraph) >= 100)""",
)
_EVC = "select editor_id, turn, cursor, paragraph, char_count from found"

_UNIFIED = tq.RESOLVED + """, cut as (
  select r.note_path, r.span_no, case when r.header_path = '' then r.title else r.header_path end as header_path,
    array_to_string(""" + sql.lines("o.content") + """[r.start_line:r.end_line], chr(10)) as content
  from resolved r join raw_notes o using (note_path)),
""" + sql.ANSWERS.replace("from notes", "from raw_notes") + ",\n" + tq.META + ",\n" + tq.META_ROWS + """,
names as (select note_path, string_agg(name, '|' order by pos) as concepts from concepts_out group by note_path),
payload as (
  select c.note_path || '-chunk-' || c.span_no as chunk_id, c.note_path as file_path, c.header_path, c.content,
    case when blank then '' else m.summary end as summary,
    case when blank then '' else array_to_string(list_filter([m.tags, m.category], lambda x: x <> ''), '|') end as tags,
    case when blank then '' else coalesce(n.concepts, '') end as concepts, length(c.content) as word_count
  from (select *, """ + sql.trim("content") + """ = '' as blank from cut) c join meta m using (note_path) left join names n using (note_path)),
u_content as (select chunk_id as key, content as text from payload),
u_summary as (select chunk_id as key, case when summary <> '' then summary else substr(content, 1, 200) end as text from payload),
u_title as (select chunk_id as key, case when header_path <> '' then header_path else file_path end as text from payload),
""" + ",\n".join(vq._hash_vec(f"uv_{n}", f"u_{n}") for n in ("content", "summary", "title"))

_AMBIENT = _EV.rstrip() + """,
fired as (select editor_id || '@' || epoch_us(ts) as key, paragraph as text from found where next_ts is null or next_ts - ts >= interval 1 second),
""" + vq.TEXT_INDEX + ",\n" + vq._hash_vec("v_query", "fired") + """,
text_queries as (select key as query_id, v as query_vec, '' as exclude_path from v_query),
""" + vq._three(False, "text_index", "text_queries", 5) + ",\n" + vq._fuse("fused", ["kc", "ks", "kt"], 5) + "\n" + vq._FORMAT.format(index="text_index", queries="text_queries")

SQL = {
    "unified_index": _UNIFIED + f"""
select p.chunk_id, file_path, header_path, summary, tags, concepts, word_count, {NOW_MS}::bigint as indexed_at,
  round(c.v[3]::float::double, 6) as content_vec, round(s.v[3]::float::double, 6) as summary_vec, round(t.v[3]::float::double, 6) as title_vec
from payload p join uv_content c on c.key = p.chunk_id join uv_summary s on s.key = p.chunk_id join uv_title t on t.key = p.chunk_id""",
    "index_totals": _UNIFIED + """
select count(distinct file_path) as notes, count(*) as chunks, 0::bigint as failed_chunks,
  sum(len(list_filter(str_split(concepts, '|'), lambda x: x <> '')))::bigint as concepts, sum(word_count)::bigint as characters from payload""",
    "incremental_stream": sql.with_(
        sql.NOTES.replace("notes as (", "raw_notes as (", 1),
        f"""notes as (
  select * exclude (content), case when doc_id % 17 = 4 then ' ' || {sql.NL}
    when doc_id % 7 = 3 then content || {sql.NL} || {sql.NL} || '# Added' || {sql.NL} || 'text of ' || doc_id else content end as content
  from raw_notes where doc_id % 11 <> 5)""",
        sql.LINES, sql.HEADERS, sql.HEADER_PATHS, sql.SECTIONS, sql.chunk_ctes(MAX), recursive=True,
    )
    + "select note_path || '-chunk-' || index as chunk_id, note_path as file_path, content, header_path, start_pos, end_line from chunks",
    "vault_roundtrip": sql.with_(sql.NOTES) + "select note_path, title, case when doc_id % 10 <> 9 then content else '' end as content from notes",
    "bucketed_log": _IDX
    + f"""select {_COLS} from (
  select chunk_id, file_path, 'v2 ' || content as summary, tags, title_vec as content_vec from chunk_index where {_EVEN}
  union all select chunk_id, file_path, summary, tags, content_vec from chunk_index where not ({_EVEN}) and header_path = ''
  union all select file_path || '-chunk-9', file_path, summary, tags, content_vec from chunk_index where chunk_id like '%-chunk-0')""",
    "ambient_recommend": _AMBIENT,
    "apply_concepts": cq.APPLIED
    + f""", names as (
  select note_path, string_agg('[[_me/' || concept || ']]', '|' order by o) as links from (
    select i.note_path, b.concept, min(b.ord) as o from batch b join incoming i using (ord) group by 1, 2) group by 1)
select p.note_path, '[[_me/Kept]]' || coalesce('|' || links, '') as me_concepts, case when links is not null then '{cq.NOW_ISO}' end as me_indexed_at
from (select distinct note_path from extracted) p left join names using (note_path)""",
    "apply_registry": cq.APPLIED
    + """, uses as (select concept, count(*) as n from batch where matched group by 1),
made as (select distinct i.name as concept from batch b join incoming i using (ord) where b.is_new)
select concept, coalesce(r.note_count, 1) + coalesce(u.n, 0) as note_count, m.concept is not null or u.n is not null as used_now
from (select concept from registry union select concept from made) a
left join registry r using (concept) left join uses u using (concept) left join (select concept, concept as c2 from made) m using (concept)""".replace("m.concept is not null", "m.c2 is not null"),
    "apply_usage": cq.APPLIED
    + """ select b.concept, count(*) as note_count, count(distinct i.note_path) as distinct_notes from batch b join incoming i using (ord) group by 1""",
    "index_upsert": _IDX
    + f"""select {_COLS} from (
  select chunk_id, file_path, 'v2 ' || content as summary, tags, title_vec as content_vec from chunk_index where {_EVEN}
  union all select chunk_id, file_path, summary, tags, content_vec from chunk_index where not ({_EVEN})
  union all select file_path || '-chunk-9', file_path, summary, tags, content_vec from chunk_index where chunk_id like '%-chunk-0')""",
    "index_delete_id": _IDX + f"select {_COLS} from chunk_index where header_path = ''",
    "index_delete_file": _IDX
    + f"select {_COLS} from chunk_index where file_path not in (select file_path from chunk_index where summary = '' group by 1 having count(*) >= 2)",
    "index_count": "select 2 * count(*) as points from embeddings",
    "index_clear": "select count(*) as points_before, 0::bigint as points_after from embeddings",
    "index_stats": _IDX
    + "select count(*) as total_vectors, count(distinct file_path) as files_exact, ceil(count(*) / 5.0)::bigint as files_estimated from chunk_index",
    "legacy_expand": _IDX
    + "select chunk_id, round(content_vec[1], 6) as content_vec, round(content_vec[1], 6) as summary_vec, round(content_vec[1], 6) as title_vec from chunk_index",
    "queue_by_file": _PEND + f"select {_COLS}, seq from latest where file_path in (select file_path from busy)",
    "queue_drop_file": _PEND + f"select {_COLS}, seq from latest where file_path not in (select file_path from busy)",
    "sink_stats": _PEND + "select count(*) as total_flushed, 2::bigint as flush_count, 0::bigint as failed_flushes from pending",
    "micro_batch_sink": _PEND + f"select {_COLS} from latest",
    "incremental_index": sql.with_(*sql.CHUNK_BASE, sql.chunk_ctes(MAX), sql.NOTE_STATE, sql.STAMPS,
    """stale as (select note_path from stamps where me_indexed_at is null or me_indexed_at = '' or coalesce(mtime > stamped, false))""",
    recursive=True)
    + """select note_path || '-chunk-0' as chunk_id, note_path as file_path, 'old' as content, 3::bigint as word_count
from notes where note_path not in (select note_path from stale)
union all
select note_path || '-chunk-' || index, note_path, content, length(content) from chunks where note_path in (select note_path from stale) and note_path not in (select note_path from notes where doc_id % 17 = 3)""",
    "paragraph_extract": _EV + _EVC,
    "paragraph_debounce": _EV + _EVC + " where next_ts is null or next_ts - ts >= interval 1 second",
}
