"""DuckDB SQL for the operators that SQL can express."""

SQL = {
    "op4_url_rules": r"""
with p as (
  select page_id,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
q as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p),
r(rhost, rpath, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
select page_id, host, path,
  (select rhost || rpath from r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
   order by length(rhost || rpath) desc, length(rhost) desc limit 1) as rule,
  coalesce((select verdict from r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
   order by length(rhost || rpath) desc, length(rhost) desc limit 1), 'allow') as verdict
from q
""",
    "op8_quality_rules": r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
win as (
  select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k
  from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
hit as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as n from win) where n > 1),
rep as (select rid, count(*) as n_repeat_words from (
  select distinct rid, i + o as p from hit, (values (0), (1), (2)) v(o)) group by rid),
ln as (
  select rid, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n
  from (select rid, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]')),
lf as (
  select rid, count(*) - count(distinct x) as n_dup_lines, sum(length(x)) as line_chars, sum(case when
      not regexp_matches(x, '[\p{L}\p{N}]')
      or (n >= 3 and 2 * (length(x) - length(translate(x, '!?', ''))) >= n)
      or 10 * (length(x) - length(translate(x, '#*$%&|<>', ''))) >= 3 * n
      or (n <= 2 and not regexp_matches(x, '[.!?:;\x{3002}][)\x22'']*[\x20\x09-\x0D]*$'))
      or (n >= 5 and not regexp_matches(x, '\p{Ll}') and regexp_matches(x, '\p{Lu}'))
      or regexp_matches(lower(x), 'cookie policy|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|click here|sign up now|subscribe to our|add to cart|lorem ipsum')
      then length(x) else 0 end) as lost_chars
  from ln group by rid),
f as (
  select d.doc_id, len(ws)::bigint as n_words,
    length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(line_chars, 0) as line_chars, coalesce(lost_chars, 0) as lost_chars
  from d join w using (rid) left join rep using (rid) left join lf using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_chars <= 50 * line_chars as kept
from f
""",
    "op12_importance_resampling": r"""
with crc(tab) as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i))),
w as (
  select 0 as kind, rid, doc_id, unnest(regexp_extract_all(x, '[0-9a-z\x{80}-\x{10FFFF}]+')) as word
  from (select row_number() over () as rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents)
  union all
  select 1, null, null, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'))
  from benchmark),
h as (
  select word, xor(4294967295, list_reduce(
      list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::bigint),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint)) % 10000 as bucket
  from (select word, hex(encode(word)) as x from (select distinct word from w)), crc),
n as (select bucket, sum(case when kind = 0 then 1 else 0 end) as s, sum(kind) as t from w join h using (word) group by bucket),
g as (
  select bucket, floor(1000 * ln(((t + 1) * (sum(s) over () + 10000))::double / ((s + 1) * (sum(t) over () + 10000))::double))::bigint as gain from n),
f as (
  select rid, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight
  from w join h using (word) join g using (bucket) where kind = 0 group by rid),
d as (
  select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from (select row_number() over () as rid, doc_id from documents) left join f using (rid)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from d where n_features >= 20)
select doc_id, n_features, weight, score::bigint as score, case when rank <= 10 * n // 100 then rank end::bigint as rank
from d left join r using (doc_id)
""",
    "op13_hard_negatives": r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.x, b.x)::bigint as score
  from v a, v b where a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank,
  s.vec_id as negative_id, positive_score, s.score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
""",
}
