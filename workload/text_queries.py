"""Markdown structure, preprocessing and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import links, spans as sp
from quillmesh.functions import markdown as md
from quillmesh.functions import metadata as meta
from quillmesh.functions.text import basename, lines_of, nonblank_queries, numbered, percent_badge
from quillmesh.operators.embedding import embed_texts, split_results
from quillmesh.operators import chunking
from quillmesh.operators.concepts import skip_notes
from quillmesh.sources.notes import scan_notes
from workload import inputs as src
from workload import inputs_sql as sql

C = F.col
MAX = chunking.INDEX_CHUNK_CHARS

METADATA_TEMPLATE = "Summarise as JSON:\n{content}\nJSON only."
SPAN_TEMPLATE = "Split into topics.\nTitle: {title}\n{numbered}"


def big(*names):
    return [C(n).cast("bigint").alias(n) for n in names]


def q_scan_notes(spark, d):
    return scan_notes(src.notes(spark, d)).select(
        "note_path", "title", basename(C("note_path")).alias("file_name"), F.md5(C("content").cast("binary")).alias("content_md5")
    )


def q_md_headers(spark, d):
    n = src.notes(spark, d).select("note_path", F.posexplode(md.headers(C("content"))).alias("i", "h"))
    return n.select("note_path", C("h.level").alias("level"), C("h.header_text").alias("header_text"), C("h.position").alias("position")).select(
        "note_path", *big("level", "position"), "header_text"
    )


def _paths(spark, d):
    n = src.notes(spark, d).select("note_path", md.headers(C("content")).alias("hs"))
    return n.select("note_path", F.posexplode(md.header_paths(C("hs"))).alias("i", "path"))


def q_md_header_path(spark, d):
    return _paths(spark, d).select(
        "note_path",
        C("i").cast("bigint").alias("header_index"),
        F.size("path").cast("bigint").alias("depth"),
        F.array_join(F.transform("path", lambda s: F.concat(s["level"].cast("string"), F.lit(":"), s["text"])), "/").alias("path"),
    )


def q_md_header_path_str(spark, d):
    return _paths(spark, d).select(
        "note_path", C("i").cast("bigint").alias("header_index"), md.header_path_text(C("path")).alias("header_path")
    )


def q_md_sections(spark, d):
    n = src.notes(spark, d).select("note_path", F.posexplode(md.sections(C("content"))).alias("section_index", "s"))
    return n.select("note_path", "section_index", "s.*").select(
        "note_path", *big("section_index", "start_pos", "end_pos", "start_line", "end_line"), "content", "header_path"
    )


def q_md_line_number(spark, d):
    n = src.notes(spark, d)
    pos = F.floor(F.length("content") * C("doc_id") / (C("doc_id") + 3)).cast("int")
    return n.select(
        "note_path",
        pos.cast("bigint").alias("position"),
        md.line_number_at(C("content"), pos).cast("bigint").alias("line_number"),
    )


def q_chunk_greedy_pack(spark, d):
    n = src.notes(spark, d).select("note_path", F.posexplode(md.greedy_pack(C("content"), MAX)).alias("part_no", "part"))
    return n.select("note_path", *big("part_no"), "part")


def q_split_long_line(spark, d):
    n = src.notes(spark, d).select("note_path", F.posexplode(lines_of(C("content"))).alias("line_no", "line"))
    n = n.filter(F.length("line") > MAX).select(
        "note_path", "line_no", F.posexplode(md.split_long_line(C("line"), MAX)).alias("piece_no", "piece")
    )
    return n.select("note_path", *big("line_no", "piece_no"), "piece")


def _chunk_rows(df):
    return df.select("note_path", *big("index", "start_pos", "end_pos", "start_line", "end_line"), "content", "header_path")


def q_chunk_no_headers(spark, d):
    n = src.notes(spark, d).filter(F.size(md.headers(C("content"))) == 0)
    return _chunk_rows(chunking.chunk_notes(n, MAX))


def q_md_chunks(spark, d):
    return _chunk_rows(chunking.chunk_notes(src.notes(spark, d), MAX))


def q_long_note_chunks(spark, d):
    """Rule-based chunks of notes with very many lines."""
    return _chunk_rows(chunking.chunk_notes(src.long_notes(spark, d), MAX))


def q_long_note_masks(spark, d):
    return src.long_notes(spark, d).select("note_path", F.md5(md.preprocess(C("content")).cast("binary")).alias("cleaned_md5"))


def q_preprocess_notes(spark, d):
    return src.notes(spark, d).select("note_path", md.preprocess(C("content")).alias("cleaned"))


def _kinds(spark, d):
    n = src.notes(spark, d).select("note_path", F.inline(md.classify_lines(C("content"))))
    return n.withColumn("line_no", C("line_no").cast("bigint"))


def q_frontmatter_span(spark, d):
    return src.notes(spark, d).select(
        "note_path", md.frontmatter_lines(lines_of(C("content"))).cast("bigint").alias("frontmatter_lines")
    )


def q_fence_state(spark, d):
    k = _kinds(spark, d).filter(C("kind").isin("fence_start", "fence_end", "code"))
    return k.select("note_path", "line_no", "kind", F.when(C("kind") == "fence_start", C("code_lang")).otherwise("").alias("code_lang"))


def q_image_lines(spark, d):
    return _kinds(spark, d).filter(C("kind") == "image").select("note_path", "line_no", C("raw").alias("line"))


def q_table_rows(spark, d):
    return _kinds(spark, d).filter(C("kind") == "table").select("note_path", "line_no", C("raw").alias("line"))


def q_add_line_numbers(spark, d):
    return src.notes(spark, d).select("note_path", md.add_line_numbers(C("content")).alias("numbered"))


def _span_rows(df):
    s = numbered(df, "spans", "note_path", pos="span_no", item="s").select("note_path", "span_no", "s.*")
    return s.select("note_path", *big("span_no", "start_line", "end_line"), "title", "header_path")


def _parsed_spans(spark, d):
    a = src.span_answers(src.notes(spark, d))
    return a.select("note_path", sp.parse_spans(C("response"), F.size(lines_of(C("content")))).alias("spans"))


def q_normalize_spans(spark, d):
    return _span_rows(_parsed_spans(spark, d))


def q_merge_spans(spark, d):
    return _span_rows(_parsed_spans(spark, d).withColumn("spans", sp.merge_spans(C("spans"))))


def q_spans_fallback(spark, d):
    a = src.span_answers(src.notes(spark, d))
    cleaned = a.select("note_path", "response", md.preprocess(C("content")).alias("cleaned"))
    spans = chunking.resolved_spans(C("response"), C("cleaned"), MAX)
    return _span_rows(cleaned.select("note_path", spans.alias("spans")))


def q_slice_spans(spark, d):
    n = src.notes(spark, d)
    return _chunk_rows(chunking.span_chunks(n, src.span_answers(n), MAX))


def _annotated(spark, d):
    n = src.notes(spark, d)
    answers = src.metadata_answers(n).select("note_path", "response")
    chunks = chunking.chunk_notes(n, MAX).withColumn("index", C("index"))
    joined = chunks.join(answers, "note_path")
    return joined.withColumn("metadata", meta.normalize_metadata(C("response"), C("content")))


def q_chunk_payload(spark, d):
    p = chunking.chunk_payload(_annotated(spark, d), F.lit(1705276800000).cast("bigint"))
    return p.select(
        "chunk_id", "file_path", "header_path", *big("start_line", "end_line", "word_count"), "content", "summary",
        F.array_join("tags", "|").alias("tags"), F.array_join("concepts", "|").alias("concepts"), "type", "indexed_at",
    )


def q_embedding_inputs(spark, d):
    return chunking.embedding_inputs(chunking.chunk_payload(_annotated(spark, d), F.lit(0)))


def q_skip_notes(spark, d):
    kept = skip_notes(src.notes(spark, d), paths=("src1/", "src2/en/"), tags=("de", "src7"), min_length=200)
    return kept.select("note_path", F.length("content").cast("bigint").alias("n_chars"))


def q_nonblank_query(spark, d):
    n = src.notes(spark, d).select("note_path", F.posexplode(lines_of(C("content"))).alias("line_no", "query"))
    n = n.withColumn("query", F.when(C("line_no") % 6 == 5, F.lit(" \t　")).otherwise(C("query")))
    return nonblank_queries(n).groupBy("note_path").agg(F.count(F.lit(1)).alias("n_queries"))


def q_wikilink_concepts(spark, d):
    n = src.notes(spark, d).select("note_path", F.posexplode(links.wikilink_concepts(C("content"))).alias("ord", "concept"))
    return n.select("note_path", *big("ord"), "concept")


def _metadata(spark, d):
    a = src.metadata_answers(src.notes(spark, d))
    return a.select("note_path", meta.normalize_metadata(C("response"), C("content")).alias("m"))


def q_normalize_tags(spark, d):
    a = src.notes(spark, d).select("note_path", meta.normalize_tags(F.split("content", "[ \n]")).alias("tags"))
    return a.select("note_path", F.array_join("tags", "|").alias("tags"))


def q_normalize_category(spark, d):
    n = src.notes(spark, d)
    raw = F.when(C("doc_id") % 3 == 0, "读书笔记").when(C("doc_id") % 3 == 1, C("title")).otherwise(F.lit(None))
    return n.select("note_path", meta.normalize_category(raw).alias("category"))


def _concept_list(c):
    return F.array_join(
        F.transform(c, lambda x: F.concat(x["name"], F.lit("="), F.round(x["confidence"], 2).cast("decimal(6,2)").cast("string"))), "|"
    )


def q_normalize_concepts(spark, d):
    m = numbered(_metadata(spark, d), "m.concepts", "note_path", pos="pos", item="c")
    return m.select("note_path", *big("pos"), C("c.name").alias("name"), C("c.confidence").alias("confidence"))


def q_normalize_metadata(spark, d):
    m = _metadata(spark, d)
    return m.select(
        "note_path",
        C("m.summary").alias("summary"),
        F.array_join("m.tags", "|").alias("tags"),
        C("m.category").alias("category"),
        _concept_list(C("m.concepts")).alias("concepts"),
    )


def q_concept_reason(spark, d):
    m = _metadata(spark, d).join(src.notes(spark, d).select("note_path", "content"), "note_path")
    first = F.get(F.transform(md.header_paths(md.headers(C("content"))), md.header_path_text), F.lit(0))
    path = F.coalesce(first, F.lit(""))
    rows = m.select("note_path", F.posexplode(meta.concept_details(C("m.concepts"), C("m.summary"), path)).alias("pos", "c"))
    return rows.select("note_path", *big("pos"), "c.name", "c.confidence", "c.reason")


def q_wikilink_wrap(spark, d):
    return src.notes(spark, d).select("note_path", links.wrap(C("title")).alias("link"))


def q_truncate_prompt(spark, d):
    n = src.notes(spark, d)
    return n.select(
        "note_path",
        meta.metadata_prompt(C("content"), METADATA_TEMPLATE).alias("metadata_prompt"),
        meta.span_prompt(C("content"), C("title"), SPAN_TEMPLATE).alias("span_prompt"),
    )


def q_keyword_category(spark, d):
    return src.notes(spark, d).select("note_path", meta.keyword_category(C("content")).alias("category"))


DIM = 16


def q_embed_text(spark, d):
    """Notes through the batch adapter; a few that the model refuses fail by themselves and are reported."""
    done, failed = split_results(embed_texts(src.notes(spark, d).select("note_path", C("content").alias("text")), _choosy(), continue_on_error=True))
    slots = done.select("note_path", F.posexplode("vec").alias("slot", "value"))
    good = slots.select("note_path", *big("slot"), F.round(C("value").cast("double"), 6).alias("value"), F.lit("").alias("error"))
    return good.unionByName(failed.select("note_path", F.lit(-1).cast("bigint").alias("slot"), F.lit(0.0).alias("value"), "error"))


REFUSED = "00"


def _choosy(dim=DIM, refused=REFUSED):
    """Word-hash vectors as a plain callable that, like a model, refuses some texts for what they say: one in 256 by digest."""

    def embed(texts):
        import hashlib
        import re

        out = []
        for text in texts:
            if hashlib.md5(text.encode()).hexdigest().startswith(refused):
                raise ValueError("text refused")
            counts = [0.0] * dim
            for word in re.findall(r"[^ \n]+", text.lower()):
                counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim] += 1.0
            norm = sum(c * c for c in counts) ** 0.5
            out.append([c / norm if norm else 0.0 for c in counts])
        return out

    return embed


def q_score_badge(spark, d):
    m = src.incoming(spark, d)
    return m.select("ord", percent_badge(C("confidence")).cast("bigint").alias("badge"))


QUERIES = {
    k[2:]: v for k, v in list(globals().items()) if k.startswith("q_") and callable(v)
}

# ---------------------------------------------------------------- SQL

_BASE = sql.CHUNK_BASE
_CHUNKS = sql.with_(*_BASE, sql.chunk_ctes(MAX), recursive=True)

_SPANS = f"""items as (
  select note_path, k - 1 as ord, item, total from (
    select note_path, len({sql.lines('content')}) as total,
      unnest(json_extract(case when json_valid(response) then response else '{{}}' end, '$.chunks[*]')) as item,
      generate_subscripts(json_extract(case when json_valid(response) then response else '{{}}' end, '$.chunks[*]'), 1) as k
    from span_answers)),
picked as (
  select note_path, ord, total,
    case when coalesce(json_type(item, '$.startLine'), 'NULL') = 'NULL' and (json_type(item, '$.start_line') is not null or json_type(item, '$.startLine') is null) then json_extract_string(item, '$.start_line') else json_extract_string(item, '$.startLine') end as s_text,
    case when coalesce(json_type(item, '$.startLine'), 'NULL') = 'NULL' then json_type(item, '$.start_line') else json_type(item, '$.startLine') end as s_type,
    case when coalesce(json_type(item, '$.endLine'), 'NULL') = 'NULL' then json_extract_string(item, '$.end_line') else json_extract_string(item, '$.endLine') end as e_text,
    case when coalesce(json_type(item, '$.endLine'), 'NULL') = 'NULL' then json_type(item, '$.end_line') else json_type(item, '$.endLine') end as e_type,
    {sql.trim("coalesce(json_extract_string(item, '$.title'), '')")} as t
  from items),
numbered as (
  select note_path, ord, total, t,
    case s_type when 'NULL' then 0 else try_cast(s_text as double) end as s,
    case e_type when 'NULL' then 0 else try_cast(e_text as double) end as e
  from picked),
clamped as (
  select note_path, ord, t, greatest(1, least(total, s)) as start_line,
    greatest(greatest(1, least(total, s)), least(total, e)) as end_line
  from numbered where s is not null and e is not null),
norm as (
  select note_path, row_number() over (partition by note_path order by start_line, ord) - 1 as span_no,
    start_line::bigint as start_line, end_line::bigint as end_line,
    case when t = '' then '未命名段落' else t end as title, t as header_path
  from clamped),
flagged as (
  select *, case when start_line <= max(end_line) over (partition by note_path order by span_no rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens
  from norm),
grouped as (select *, sum(opens) over (partition by note_path order by span_no) as island from flagged),
merged as (
  select note_path, island - 1 as span_no, min(start_line) as start_line, max(end_line) as end_line,
    arg_min(title, span_no) as title, arg_min(header_path, span_no) as header_path
  from grouped group by note_path, island)"""

# Rule chunks of the *masked* text: the chunk CTEs run over notes whose content is the mask.
RESOLVED = sql.with_(
    sql.NOTES.replace("notes as (", "raw_notes as (", 1),
    sql.LINES.replace("lines as (", "raw_lines as (", 1).replace("from notes", "from raw_notes"),
    sql.KINDS.replace("from lines", "from raw_lines"),
    sql.MASKED,
    "notes as (select r.* exclude (content), m.cleaned as content from raw_notes r join masked m using (note_path))",
    sql.SPAN_ANSWERS,
    _SPANS,
    sql.LINES,
    sql.HEADERS,
    sql.HEADER_PATHS,
    sql.SECTIONS,
    sql.chunk_ctes(MAX),
    """resolved as (
  select note_path, span_no, start_line, end_line, title, header_path from merged
  union all
  select note_path, index, start_line, end_line, case when header_path = '' then '未命名段落' else header_path end, header_path
  from chunks where note_path not in (select note_path from merged))""",
    recursive=True,
)

_ANSWERED = sql.with_(sql.NOTES, sql.SPAN_ANSWERS, _SPANS)

META = f"""parsed as (
  select note_path, content, doc_id, regexp_replace(response, '```json\\n?|\\n?```', '', 'g') as j from answers),
usable as (select *, json_valid(j) as ok, case when json_valid(j) then j else '{{}}' end as js from parsed),
tag_items as (
  select note_path, k, t from (
    select note_path, unnest(from_json(coalesce(json_extract(js, '$.tags'), '[]'), '["VARCHAR"]')) as t,
      generate_subscripts(from_json(coalesce(json_extract(js, '$.tags'), '[]'), '["VARCHAR"]'), 1) as k
    from usable)
  where t is not null and {sql.trim('t')} <> ''),
tags_out as (
  select note_path, string_agg(t, '|' order by k) as tags from (
    select note_path, t, k from (select note_path, t, min(k) as k from tag_items group by note_path, t)
    qualify row_number() over (partition by note_path order by k) <= 5)
  group by note_path),
concept_items as (
  select note_path, unnest(json_extract(js, '$.concepts[*]')) as item,
    generate_subscripts(json_extract(js, '$.concepts[*]'), 1) as k from usable),
concept_vals as (
  select note_path, k,
    {sql.trim("case when json_type(item) = 'VARCHAR' then json_extract_string(item, '$') when json_type(item, '$.name') = 'VARCHAR' then json_extract_string(item, '$.name') end")} as name,
    case when json_type(item) = 'VARCHAR' then 0.7
         when json_type(item, '$.confidence') = 'NULL' then 0.0
         else coalesce(try_cast(json_extract_string(item, '$.confidence') as double), 0.7) end::double as confidence
  from concept_items),
concept_best as (
  select note_path, name, confidence, first_k from (
    select *, min(k) over (partition by note_path, lower(name)) as first_k,
      row_number() over (partition by note_path, lower(name) order by confidence desc, k) as rn
    from concept_vals where coalesce(name, '') <> '')
  where rn = 1),
concepts_out as (
  select note_path, name, confidence, row_number() over (partition by note_path order by first_k) - 1 as pos from concept_best
  qualify pos < 5)"""
META_BASE = (sql.NOTES, sql.ANSWERS, META)

META_ROWS = """meta as (
  select u.note_path, u.ok, case when u.ok then coalesce(json_extract_string(js, '$.summary'), '') else '' end as summary,
    coalesce(t.tags, '') as tags,
    case when not u.ok then '' when json_extract_string(js, '$.category') in ('技术笔记', '生活日记', '读书笔记', '想法灵感', '工作记录')
      then json_extract_string(js, '$.category') else '技术笔记' end as category
  from usable u left join tags_out t using (note_path))"""

_KEYWORDS = {
    name: "[" + ", ".join(f"'{k}'" for k in words) + "]" for name, words in meta.CATEGORY_KEYWORDS.items()
}
_HITS = ", ".join(
    f"len(list_filter({_KEYWORDS[n]}, lambda k: contains(lower(content), k))) as {n}" for n in ("tech", "diary", "book", "idea")
)

_PAYLOAD = sql.with_(
    *_BASE,
    sql.chunk_ctes(MAX),
    sql.ANSWERS,
    META,
    META_ROWS,
    """names as (select note_path, string_agg(name, '|' order by pos) as concepts from concepts_out group by note_path),
payload as (
  select c.note_path || '-chunk-' || c.index as chunk_id, c.note_path as file_path, c.header_path, c.start_line, c.end_line,
    length(c.content) as word_count, c.content,
    case when blank then '' else m.summary end as summary,
    case when blank then '' else array_to_string(list_filter([m.tags, m.category], lambda x: x <> ''), '|') end as tags,
    case when blank then '' else coalesce(n.concepts, '') end as concepts
  from (select *, """
    + sql.trim("content")
    + """ = '' as blank from chunks) c join meta m using (note_path) left join names n using (note_path))""",
    recursive=True,
)

_KINDS = sql.with_(sql.NOTES, sql.LINES, sql.KINDS)

SQL = {
    "scan_notes": sql.with_(sql.NOTES)
    + "select note_path, title, regexp_extract(note_path, '([^/]*)$', 1) as file_name, md5(content) as content_md5 from notes where note_path like '%.md'",
    "md_headers": sql.with_(sql.NOTES, sql.LINES, sql.HEADERS) + "select note_path, level, position, header_text from headers",
    "md_header_path": sql.with_(sql.NOTES, sql.LINES, sql.HEADERS)
    + """select c.note_path, c.h - 1 as header_index, count(*) as depth, string_agg(a.level || ':' || a.header_text, '/' order by a.h) as path
from headers c join headers a on a.note_path = c.note_path and a.h <= c.h
where not exists (select 1 from headers b where b.note_path = c.note_path and b.h > a.h and b.h <= c.h and b.level <= a.level)
group by c.note_path, c.h""",
    "md_header_path_str": sql.with_(sql.NOTES, sql.LINES, sql.HEADERS, sql.HEADER_PATHS)
    + "select note_path, h - 1 as header_index, header_path from header_paths",
    "md_sections": sql.with_(*_BASE)
    + "select note_path, h - 1 as section_index, start_pos, end_pos, start_line, end_line, content, header_path from sections",
    "md_line_number": sql.with_(sql.NOTES)
    + f"""select note_path, position, 1 + {sql.newlines('substr(content, 1, position)')} as line_number
from (select *, floor(length(content) * doc_id / (doc_id + 3)::double)::bigint as position from notes)""",
    "chunk_greedy_pack": sql.with_(
        sql.NOTES, "texts as (select note_path as key, content as text from notes)", sql.pack("texts", MAX), recursive=True
    )
    + "select key as note_path, generate_subscripts(parts, 1) - 1 as part_no, unnest(parts) as part from packed",
    "split_long_line": sql.with_(sql.NOTES, sql.LINES)
    + f"""select note_path, line_no - 1 as line_no, i as piece_no, substr(line, (i * {MAX} + 1)::bigint, {MAX}) as piece
from (select *, unnest(range(0, ((length(line) + {MAX - 1}) // {MAX})::bigint)) as i from lines where length(line) > {MAX})""",
    "chunk_no_headers": _CHUNKS + "select * from chunks where note_path not in (select note_path from headers)",
    "md_chunks": _CHUNKS + "select * from chunks",
    "long_note_chunks": _CHUNKS.replace(sql.NOTES, sql.LONG_NOTES) + "select * from chunks",
    "long_note_masks": sql.with_(sql.LONG_NOTES, sql.LINES, sql.KINDS, sql.MASKED) + "select note_path, md5(cleaned) as cleaned_md5 from masked",
    "preprocess_notes": sql.with_(sql.NOTES, sql.LINES, sql.KINDS, sql.MASKED) + "select * from masked",
    "frontmatter_span": _KINDS + "select note_path, coalesce(last_front, 0) as frontmatter_lines from front",
    "fence_state": _KINDS
    + "select note_path, line_no, kind, lang as code_lang from kinds where kind in ('fence_start', 'fence_end', 'code')",
    "image_lines": _KINDS + "select note_path, line_no, line from kinds where kind = 'image'",
    "table_rows": _KINDS + "select note_path, line_no, line from kinds where kind = 'table'",
    "add_line_numbers": sql.with_(sql.NOTES, sql.LINES)
    + f"""select note_path, string_agg(lpad(line_no::varchar, length(total::varchar)::int, '0') || ': ' || line, {sql.NL} order by line_no) as numbered
from (select *, count(*) over (partition by note_path) as total from lines) group by note_path""",
    "normalize_spans": _ANSWERED + "select note_path, span_no, start_line, end_line, title, header_path from norm",
    "merge_spans": _ANSWERED + "select note_path, span_no, start_line, end_line, title, header_path from merged",
    "spans_fallback": RESOLVED + "select * from resolved",
    "slice_spans": RESOLVED
    + f"""select note_path, span_no as index, start_pos, start_pos + length(content) as end_pos, start_line, end_line, content, header_path
from (
  select r.note_path, r.span_no, r.start_line, r.end_line, case when r.header_path = '' then r.title else r.header_path end as header_path,
    array_to_string({sql.lines('o.content')}[r.start_line:r.end_line], {sql.NL}) as content,
    coalesce(length(array_to_string({sql.lines('o.content')}[1:r.start_line - 1], {sql.NL})) + (r.start_line > 1)::int, 0)::bigint as start_pos
  from resolved r join raw_notes o using (note_path))""",
    "chunk_payload": _PAYLOAD
    + "select chunk_id, file_path, header_path, start_line, end_line, word_count, content, summary, tags, concepts, 'chunk' as type, 1705276800000::bigint as indexed_at from payload",
    "embedding_inputs": _PAYLOAD
    + """select chunk_id, content as content_text, case when summary <> '' then summary else substr(content, 1, 200) end as summary_text,
  case when header_path <> '' then header_path else file_path end as title_text from payload""",
    "skip_notes": sql.with_(sql.NOTES)
    + """select note_path, length(content) as n_chars from notes
where not (starts_with(note_path, 'src1/') or starts_with(note_path, 'src2/en/')) and not list_has_any(tags, ['de', 'src7']) and length(content) >= 200""",
    "nonblank_query": sql.with_(sql.NOTES, sql.LINES)
    + f"""select note_path, count(*) as n_queries from (
  select note_path, case when (line_no - 1) % 6 = 5 then ' ' || chr(9) || chr(12288) else line end as query from lines)
where {sql.trim('query')} <> '' group by note_path""",
    "wikilink_concepts": sql.with_(sql.NOTES)
    + f"""select note_path, row_number() over (partition by note_path order by k) - 1 as ord, concept from (
  select note_path, concept, min(k) as k from (
    select note_path, k, case when len(parts) > 0 then parts[-1] else page end as concept from (
      select *, list_filter(str_split(page, '/'), lambda p: p <> '') as parts from (
        select note_path, k, {sql.trim("split_part(" + sql.trim("split_part(" + sql.trim("raw") + ", '|', 1)") + ", '#', 1)")} as page from (
          select note_path, unnest(regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1)) as raw,
            generate_subscripts(regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1), 1) as k from notes))))
  where concept <> '' group by note_path, concept)""",
    "normalize_tags": sql.with_(sql.NOTES)
    + f"""select n.note_path, coalesce(t.tags, '') as tags from notes n left join (
  select note_path, string_agg(t, '|' order by k) as tags from (
    select note_path, t, min(k) as k from (
      select note_path, unnest(regexp_split_to_array(content, '[ \\n]')) as t, generate_subscripts(regexp_split_to_array(content, '[ \\n]'), 1) as k from notes)
    where {sql.trim('t')} <> '' group by note_path, t qualify row_number() over (partition by note_path order by min(k)) <= 5)
  group by note_path) t using (note_path)""",
    "normalize_category": sql.with_(sql.NOTES)
    + "select note_path, case when doc_id % 3 = 0 then '读书笔记' else '技术笔记' end as category from notes",
    "normalize_concepts": sql.with_(*META_BASE) + "select note_path, pos, name, confidence from concepts_out",
    "normalize_metadata": sql.with_(*META_BASE, META_ROWS)
    + """select note_path, summary, tags, category, coalesce(c.concepts, '') as concepts from meta left join (
  select note_path, string_agg(name || '=' || confidence::decimal(6,2), '|' order by pos) as concepts from concepts_out group by note_path) c using (note_path)""",
    "concept_reason": sql.with_(*META_BASE, META_ROWS, sql.LINES, sql.HEADERS, sql.HEADER_PATHS)
    + f"""select c.note_path, c.pos, c.name, c.confidence,
  case when {sql.trim('m.summary')} <> '' then {sql.trim('m.summary')} when coalesce(p.header_path, '') <> '' then '片段主题: ' || p.header_path else '来自片段内容' end as reason
from concepts_out c join meta m using (note_path) left join header_paths p on p.note_path = c.note_path and p.h = 1""",
    "wikilink_wrap": sql.with_(sql.NOTES) + "select note_path, '[[_me/' || title || ']]' as link from notes",
    "truncate_prompt": sql.with_(sql.NOTES, sql.LINES)
    + f"""select n.note_path, 'Summarise as JSON:' || {sql.NL} || case when length(n.content) > 2000 then substr(n.content, 1, 2000) || '...' else n.content end || {sql.NL} || 'JSON only.' as metadata_prompt,
  'Split into topics.' || {sql.NL} || 'Title: ' || n.title || {sql.NL} || l.numbered as span_prompt
from notes n join (
  select note_path, string_agg(lpad(line_no::varchar, length(total::varchar)::int, '0') || ': ' || line, {sql.NL} order by line_no) as numbered
  from (select *, count(*) over (partition by note_path) as total from lines) group by note_path) l using (note_path)""",
    "keyword_category": sql.with_(sql.NOTES)
    + f"""select note_path, case when greatest(tech, diary, book, idea) = 0 then '技术笔记'
  when tech = greatest(tech, diary, book, idea) then '技术笔记' when diary = greatest(tech, diary, book, idea) then '生活日记'
  when book = greatest(tech, diary, book, idea) then '读书笔记' else '想法灵感' end as category
from (select note_path, {_HITS} from notes)""",
    "embed_text": sql.with_(sql.NOTES)
    + f"""select note_path, -1::bigint as slot, 0.0::double as value, 'text refused' as error from notes where starts_with(md5(content), '{REFUSED}')
union all
select note_path, slot, round((case when norm = 0 then 0 else c / norm end)::float::double, 6) as value, '' as error from (
  select note_path, slot, c, sqrt(sum(c * c) over (partition by note_path)) as norm from (
    select g.note_path, g.slot, coalesce(w.c, 0)::double as c
    from (select note_path, unnest(range(0, {DIM})) as slot from notes where not starts_with(md5(content), '{REFUSED}')) g left join (
      select note_path, ('0x' || substr(md5(w), 1, 8))::bigint % {DIM} as slot, count(*) as c from (
        select note_path, unnest(regexp_extract_all(lower(content), '[^ \\n]+')) as w from notes) group by all) w
    on w.note_path = g.note_path and w.slot = g.slot))""",
    "score_badge": sql.with_(sql.EMB, sql.INCOMING) + "select ord, floor(confidence * 100.0::double + 0.5::double)::bigint as badge from incoming",
}
