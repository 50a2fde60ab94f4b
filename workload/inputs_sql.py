"""The same derived inputs as DuckDB CTEs (same rules as inputs)."""

from quillmesh.functions.text import SPACE

NL = "chr(10)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def rtrim(x: str) -> str:
    return f"regexp_replace({x}, '[{SPACE}]+$', '', 'g')"


def lines(x: str) -> str:
    return f"str_split({x}, {NL})"


def newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, {NL}, '')))"


def with_(*ctes: str, recursive: bool = False) -> str:
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(ctes) + "\n"


NOTES = f"""notes as (
  select doc_id, source || '/' || lang || '/doc_' || doc_id || '.md' as note_path, 'doc_' || doc_id as title,
    [lang, source] as tags, timestamp '2024-01-15 00:00:00' as mtime,
    (case when doc_id % 7 = 0 then '---' || {NL} || 'status: x' || {NL} || '---' || {NL} else '' end) ||
    array_to_string(list_transform({lines('text')}, lambda line, j:
      case when doc_id % 4 <> 0 and (j - 1 + doc_id) % 5 = 0
             then repeat('#', (1 + ((j - 1 + doc_id) // 5) % 3)::int) || ' ' || substr(line, 1, 40)
           when (j - 1 + doc_id) % 13 = 3 then '```py'
           when (j - 1 + doc_id) % 13 = 6 then '```'
           when (j - 1 + doc_id) % 13 = 8 then '![[img.png]]'
           when (j - 1 + doc_id) % 13 = 9 then 'a | b'
           when (j - 1 + doc_id) % 13 = 10 then '--- | ---'
           when (j - 1 + doc_id) % 13 = 11 then 'c | d'
           when doc_id % 3 = 1 and (j - 1 + doc_id) % 4 = 1
             then line || ' [[topics/Concept_' || (doc_id % 50) || '|alias]]'
           else line end), {NL}) as content
  from documents)"""

NOTE_STATE = """note_state as (
  select doc_id, source || '/' || lang || '/doc_' || doc_id || '.md' as note_path,
    case when doc_id % 5 = 0 then null
         when doc_id % 5 = 1 then []::varchar[]
         when doc_id % 5 = 2 then ['[[_me/Concept_' || (doc_id % 50) || ']]', '[[Loose_' || (doc_id % 9) || ']]']
         else ['[[_me/Concept_' || (doc_id % 50) || ']]', '[[_me/Concept_' || ((doc_id * 7) % 50) || ']]'] end as me_concepts,
    case when doc_id % 11 = 0 then 'bad' when doc_id % 5 = 0 then null
         else '2024-01-' || lpad((1 + doc_id % 28)::varchar, 2, '0') || 'T00:00:00.000Z' end as me_indexed_at,
    timestamp '2024-01-15 00:00:00' as mtime
  from documents)"""

STAMPS = """stamps as (select *, try_cast(replace(me_indexed_at, 'Z', '') as timestamp) as stamped from note_state)"""

PROPOSED = """proposed as (
  select note_path, ord, name from (
    select note_path, unnest(range(0, 3)) as ord,
      unnest(['Concept_' || (doc_id % 50), 'New_' || (doc_id % 7), 'New_' || (doc_id % 3)]) as name
    from note_state where doc_id % 4 <> 0))"""

EMB = """emb as (select vec_id, label, embedding::double[] as v, (select count(*) from embeddings) as n from embeddings)"""

CHUNK_INDEX = """chunk_index as (
  select e.vec_id, 'f/doc_' || (e.vec_id // 5) || '.md-chunk-' || (e.vec_id % 5) as chunk_id,
    'f/doc_' || (e.vec_id // 5) || '.md' as file_path,
    case when e.vec_id % 2 = 0 then '# D' || (e.vec_id // 5) else '' end as header_path,
    'c' || e.vec_id as content,
    case when e.vec_id % 3 <> 0 then 's' || e.vec_id else '' end as summary,
    ['t' || e.label, 'g' || (e.vec_id % 3)] as tags,
    e.v as content_vec, s.v as summary_vec, t.v as title_vec
  from emb e join emb s on s.vec_id = (e.vec_id + 1) % e.n join emb t on t.vec_id = (e.vec_id // 5) * 5)"""

QUERIES = """queries as (
  select vec_id as query_id, v as query_vec,
    case when vec_id % 2 = 0 then []::varchar[] else ['g0', 'g1'] end as tags,
    'f/doc_' || (vec_id // 5) || '.md' as exclude_path
  from emb)"""

REGISTRY = """registry as (
  select 'Concept_' || e.vec_id as concept, 'about ' || e.vec_id as summary, '[[_me/Concept_' || e.vec_id || ']]' as link,
    1::bigint as note_count, timestamp '2024-01-01 00:00:00' as first_seen_at, timestamp '2024-01-02 00:00:00' as last_used_at,
    e.v as concept_vec, s.v as concept_summary_vec
  from emb e join emb s on s.vec_id = (e.vec_id + 100) % e.n)"""

INCOMING = """incoming as (
  select b * 3 + c as ord, 'f/doc_' || (b // 5) || '.md' as note_path, 'Term_' || (b * 3 + c) as name,
    'why ' || ((b * 3 + c) % 11) as reason, (((b * 3 + c) * 37) % 100) / 100.0::double as confidence,
    case when b % 4 = 2 then list_transform(own, lambda x, i: (x - side[i]) + 0.05::double * c * tilt[i])
         else list_transform(own, lambda x, i: x + e_far * far[i]) end as name_vec,
    list_transform(about, lambda x, i: x + f_noise * noise[i]) as reason_vec
  from (
    select e.vec_id as b, k.c as c, e.v as own, f.v as far, s.v as side, t.v as tilt, a.v as about, z.v as noise,
      case when e.vec_id % 4 = 0 then 0.1::double * (k.c + 1) when e.vec_id % 4 = 1 then 0.6::double else 1.2::double end as e_far,
      case when e.vec_id % 4 = 2 or (e.vec_id % 4 = 1 and k.c > 0) then 3.0::double else 0.3::double end as f_noise
    from emb e, (select unnest([0, 1, 2]) as c) k, emb f, emb s, emb t, emb a, emb z
    where f.vec_id = (e.vec_id + 200) % e.n and s.vec_id = (e.vec_id + 7) % e.n and t.vec_id = (e.vec_id + 13) % e.n
      and a.vec_id = (e.vec_id + 100) % e.n and z.vec_id = (e.vec_id + 320) % e.n))"""

_FULL = (
    "'{\"summary\":\" about ' || doc_id || ' \",\"tags\":[\"t' || (doc_id % 3) || '\",\"u\"],\"category\":\"读书笔记\","
    "\"concepts\":[{\"name\":\"Alpha ' || (doc_id % 5) || '\",\"confidence\":0.9},{\"name\":\"Beta\",\"confidence\":0.5}]}'"
)
ANSWERS = f"""answers as (
  select *, case doc_id % 8
    when 0 then {_FULL}
    when 1 then '```json' || {NL} || {_FULL} || {NL} || '```'
    when 2 then 'sorry, no JSON for ' || doc_id
    when 3 then '{{"summary":"x","tags":["a"," ","b","a",null,"c","d","e","f' || (doc_id % 4) || '"],"concepts":[]}}'
    when 4 then '{{"summary":"","tags":[],"category":"other ' || doc_id || '","concepts":null}}'
    when 5 then '{{"summary":"strings","concepts":[" Gamma ","gamma","Delta ' || (doc_id % 6) || '","",3,null]}}'
    when 6 then '{{"summary":"mixed","concepts":[{{"name":"Eps","confidence":null}},{{"name":"eps","confidence":"0.4"}},{{"name":"Zeta"}},{{"name":"zeta","confidence":0.' || (doc_id % 10) || '}},{{"name":5}},{{"confidence":1}},"Eta"]}}'
    else '{{}}' end as response
  from notes)"""

SPAN_ANSWERS = f"""span_answers as (
  select *, case doc_id % 6
    when 0 then '{{"chunks":[{{"title":"first ' || doc_id || '","startLine":1,"endLine":' || (n // 2) || '}},{{"title":"second","startLine":' || (n // 2 + 1) || ',"endLine":' || n || '}}]}}'
    when 1 then '{{"chunks":[{{"title":"late","startLine":' || (n // 2) || ',"endLine":' || n || '}},{{"title":" early ","startLine":1,"endLine":' || (n // 2 + 1) || '}}]}}'
    when 2 then '{{"chunks":[{{"title":"","startLine":1,"endLine":1}},{{"title":"two","startLine":2,"endLine":2}},{{"title":"rest","startLine":3,"endLine":' || n || '}}]}}'
    when 3 then '{{"chunks":[{{"title":null,"startLine":"1","endLine":"2"}},{{"title":"snake","start_line":3,"end_line":null}},{{"startLine":null,"start_line":4,"endLine":9}},{{"title":"missing","startLine":2}}]}}'
    when 4 then '{{"chunks":[{{"title":"rev","startLine":5,"endLine":2}},{{"title":"big","startLine":7,"endLine":9999}},{{"title":"zero","startLine":0,"endLine":-3}}]}}'
    else case when doc_id % 12 = 11 then 'no spans today' else '{{"chunks":[]}}' end end as response
  from (select *, len({lines('content')}) as n from notes))"""

EVENTS = f"""events_in as (
  select editor_id, turn, ts, content, length(content) - (case when turn % 3 = 2 then 1 else 0 end) as cursor from (
    select conv_id as editor_id, turn,
      string_agg(text, {NL} || {NL}) over w || {NL} || {NL} as content,
      timestamp '2024-01-01 00:00:00' + to_milliseconds((sum(case (conv_id + turn) % 3 when 0 then 400 when 1 then 1000 else 2500 end) over w)::bigint) as ts
    from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)))"""

ACCESS = """access_log as (
  select vec_id::varchar as chunk_id, (vec_id * 7919) % (select count(*) from embeddings) as last_access,
    'c' || vec_id as content, embedding, '{"id":' || vec_id || '}' as metadata
  from embeddings)"""

LONG_NOTES = (
    NOTES.replace("notes as (", "single_notes as (", 1)
    + f""",
notes as (
  select 'long/' || (doc_id // 100) || '.md' as note_path, string_agg(content, {NL} order by doc_id) as content
  from single_notes group by 1)"""
)

LINES = f"""lines as (
  select note_path, line, line_no,
    coalesce(sum(length(line) + 1) over (partition by note_path order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as start_pos
  from (select note_path, unnest({lines('content')}) as line, generate_subscripts({lines('content')}, 1) as line_no from notes))"""

HEADERS = f"""headers as (
  select note_path, row_number() over (partition by note_path order by line_no) as h, line_no, start_pos as position, level, header_text
  from (select *, length(regexp_extract(line, '^[{SPACE}]*(#+)', 1)) as level,
          {trim(f"regexp_replace(line, '^[{SPACE}]*#+', '')")} as header_text from lines)
  where level > 0 and header_text <> '')"""

# Ancestors of a header: for every smaller level, an earlier header that no header
# of the same or a smaller level follows before the current one.
HEADER_PATHS = """header_paths as (
  select c.note_path, c.h,
    string_agg(repeat('#', a.level::int) || ' ' || a.header_text, ' > ' order by a.h) as header_path
  from headers c join headers a on a.note_path = c.note_path and a.h <= c.h
  where a.h = c.h or a.level < (
    select min(b.level) from headers b where b.note_path = c.note_path and b.h > a.h and b.h <= c.h)
  group by c.note_path, c.h)"""

SECTIONS = """sections as (
  select h.note_path, h.h, p.header_path, h.position as start_pos, h.line_no as start_line,
    coalesce(lead(h.position) over w, length(n.content)) as end_pos,
    coalesce(lead(h.line_no) over w, len(str_split(n.content, chr(10)))) as end_line,
    substr(n.content, h.position + 1, coalesce(lead(h.position) over w, length(n.content)) - h.position) as content
  from headers h join header_paths p using (note_path, h) join notes n using (note_path)
  window w as (partition by h.note_path order by h.h))"""


def pack(source: str, max_chars: int, name: str = "packed") -> str:
    """CTEs packing ``source(key, text)``: ``{name}(key, parts)`` (needs RECURSIVE)."""
    m = max_chars
    cut = f"list_transform(range(0, ((length(line) + {m - 1}) // {m})::bigint), lambda i: substr(line, i * {m} + 1, {m}))"
    closed = f"case when cur <> '' then list_append(parts, {rtrim('cur')}) else parts end"
    return f"""{name}_long as (select key, text, {lines('text')} as ls from {source} where length(text) > {m}),
{name}_step(key, i, parts, cur) as (
  select key, 0::bigint, []::varchar[], '' from {name}_long
  union all
  select key, i + 1,
    case when length(cur) + length(line) + 1 <= {m} then parts
         when length(line) > {m} then list_concat({closed}, {cut})
         else {closed} end,
    case when length(cur) + length(line) + 1 <= {m} then cur || line || {NL}
         when length(line) > {m} then '' else line || {NL} end
  from (select s.key, s.i, s.parts, s.cur, l.ls[s.i + 1] as line
        from {name}_step s join {name}_long l on l.key = s.key where s.i < len(l.ls))),
{name} as (
  select s.key, {closed} as parts from {name}_step s join {name}_long l on l.key = s.key where s.i = len(l.ls)
  union all
  select key, [text] from {source} where length(text) <= {m})"""


def chunk_ctes(max_chars: int) -> str:
    """CTEs from notes to ``chunks`` (needs RECURSIVE, NOTES, LINES, HEADERS...)."""
    return f"""pieces as (
  select note_path, h, header_path, start_pos, end_pos, start_line, end_line, content from sections
  union all
  select note_path, 0, '', 0, length(content), 1, len({lines('content')}), content from notes
  where note_path not in (select note_path from headers)),
piece_texts as (select note_path || '#' || h as key, content as text from pieces),
{pack('piece_texts', max_chars)},
parts as (
  select p.note_path, p.h, p.header_path, p.start_pos, p.end_pos, p.start_line, p.end_line, p.content as whole,
    unnest(k.parts) as content, generate_subscripts(k.parts, 1) as part_no
  from pieces p join packed k on k.key = p.note_path || '#' || p.h),
placed as (
  select *, start_pos + coalesce(sum(length(content)) over (partition by note_path, h order by part_no rows between unbounded preceding and 1 preceding), 0)::bigint as pos
  from parts),
chunks as (
  select q.note_path, row_number() over (partition by q.note_path order by q.h, q.part_no) - 1 as index, q.content, q.header_path,
    q.pos as start_pos,
    case when length(q.whole) <= {max_chars} then q.end_pos else q.pos + length(q.content) end as end_pos,
    case when length(q.whole) <= {max_chars} then q.start_line else 1 + {newlines('substr(n.content, 1, q.pos)')} end as start_line,
    case when length(q.whole) <= {max_chars} then q.end_line else 1 + {newlines('substr(n.content, 1, q.pos + length(q.content))')} end as end_line
  from placed q join notes n using (note_path)
  where {trim('n.content')} <> '')"""


CHUNK_BASE = (NOTES, LINES, HEADERS, HEADER_PATHS, SECTIONS)

SEPARATOR = rf"^[{SPACE}]*\|?[{SPACE}]*[:\- ]+\|?[{SPACE}]*(\|[{SPACE}]*[:\- ]+[{SPACE}]*)*\|?[{SPACE}]*$"

KINDS = f"""trimmed as (select *, {trim('line')} as t from lines),
front as (
  select note_path, case when bool_or(line_no = 1 and t = '---') then min(line_no) filter (where line_no > 1 and t = '---') end as last_front
  from trimmed group by note_path),
fenced as (
  select l.*, coalesce(l.line_no <= f.last_front, false) as is_front,
    starts_with(l.t, '```') and not coalesce(l.line_no <= f.last_front, false) as is_fence,
    lead(l.line) over (partition by l.note_path order by l.line_no) as next_line
  from trimmed l join front f using (note_path)),
counted as (
  select *, sum(is_fence::int) over (partition by note_path order by line_no) as n_fence from fenced),
staged as (
  select *, case when is_front then 'frontmatter'
                 when is_fence and n_fence % 2 = 1 then 'fence_start' when is_fence then 'fence_end'
                 when n_fence % 2 = 1 then 'code'
                 when (contains(t, '![[') and contains(t, ']]')) or regexp_matches(t, '!\\[[^\\]]*\\]\\([^\\)]+\\)') then 'image'
                 else 'eligible' end as stage
  from counted),
table_events as (
  select *, case when stage <> 'eligible' then null
                 when not contains(line, '|') then 'B'
                 when coalesce(next_line, '') <> '' and regexp_matches(next_line, '{SEPARATOR}') then 'S' end as ev
  from staged),
kinds as (
  select note_path, line_no, line, t,
    case when stage <> 'eligible' then stage
         when contains(line, '|') and coalesce(last_value(ev ignore nulls) over (partition by note_path order by line_no rows between unbounded preceding and current row), 'B') = 'S' then 'table'
         else 'text' end as kind,
    case when stage = 'fence_start' then {trim("regexp_replace(t, '^```+', '')")} else '' end as lang
  from table_events)"""

MASKED = f"""masked as (
  select note_path, string_agg(case kind when 'frontmatter' then '[frontmatter]'
      when 'fence_start' then '[code block start: ' || (case when lang = '' then 'text' else lang end) || ']'
      when 'fence_end' then '[code block end]' when 'code' then '[code line]' when 'image' then '[image]'
      when 'table' then '[table row]' else line end, {NL} order by line_no) as cleaned
  from kinds group by note_path)"""
