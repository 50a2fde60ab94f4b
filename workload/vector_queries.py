"""Vector search, fusion and result shaping."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillmesh.functions.vectors import MODEL_DIMENSIONS, cosine_similarity, dimension_of, hash_embedding
from quillmesh.operators import search, tiles
from quillmesh.operators.ann import ann_topk, hyperplanes
from quillmesh.operators.fusion import DEFAULT_WEIGHTS, combine_results, rrf_fusion
from quillmesh.operators.hotset import hot_set
from quillmesh.operators.knn import nearest
from workload import inputs as src
from workload import inputs_sql as sql

C = F.col
LIMIT = search.DEFAULT_LIMIT
DIM = 16
HOT_BUDGET = 60_000
ANN_DIM, ANN_BANDS, ANN_BITS, ANN_SEED = 64, 16, 4, 7


def _scored(df, extra=()):
    return df.select(
        "query_id", *extra, "chunk_id", F.round("score", 6).alias("score"), C("rank").cast("bigint").alias("rank")
    )


def _q(spark, d):
    return src.queries(spark, d)


def _prefetched(spark, d):
    return nearest(
        _q(spark, d),
        src.chunk_index(spark, d),
        2 * LIMIT,
        vectors=[(v, "query_vec", v) for v in search.VECTOR_COLUMNS],
        query_tags="tags",
        item_tags="tags",
    )


def q_vector_topk(spark, d):
    return _scored(nearest(_q(spark, d), src.chunk_index(spark, d), 2 * LIMIT))


def q_cosine_similarity(spark, d):
    i = src.chunk_index(spark, d)
    zero = F.transform("content_vec", lambda x: x * 0)
    return i.select(
        "chunk_id",
        F.round(cosine_similarity(C("content_vec"), C("summary_vec")), 6).alias("content_summary"),
        F.round(cosine_similarity(C("content_vec"), C("title_vec")), 6).alias("content_title"),
        cosine_similarity(C("content_vec"), F.slice("title_vec", 1, 10)).alias("other_size"),
        cosine_similarity(C("content_vec"), zero).alias("zero_norm"),
    )


def q_ann_topk(spark, d):
    return _scored(
        ann_topk(_q(spark, d), src.chunk_index(spark, d), LIMIT, dim=ANN_DIM, bands=ANN_BANDS, bits=ANN_BITS, seed=ANN_SEED)
    )


IVF_SHARE = 0.25


def _inverted(spark, d):
    index = src.chunk_index(spark, d).select("chunk_id", "content_vec")
    lists = tiles.fit_lists(index, "content_vec", "chunk_id")
    return tiles.into_lists(index, "content_vec", lists), lists


def q_ivf_topk(spark, d):
    """Neighbours from the nearest quarter of the lists of an inverted file."""
    stored, lists = _inverted(spark, d)
    probes = math.ceil(IVF_SHARE * len(lists.centres))
    return _scored(tiles.ivf_topk(_q(spark, d), stored, lists, LIMIT, probes))


def q_ivf_recall(spark, d):
    """Recall and compared pairs of the inverted file for every number of lists."""
    curve = tiles.recall_curve(_q(spark, d), *_inverted(spark, d), LIMIT)
    return curve.select("probes", F.round("recall", 9).alias("recall"), F.round("pair_share", 9).alias("pair_share"))


def q_tag_filter(spark, d):
    """Content neighbours with the tag filter applied before the cut."""
    return _scored(
        nearest(_q(spark, d), src.chunk_index(spark, d), LIMIT, query_tags="tags", item_tags="tags")
    )


def q_fused_search(spark, d):
    return _scored(search.fused_search(_q(spark, d), src.chunk_index(spark, d), LIMIT))


def q_tiled_search(spark, d):
    """Fused search of the related notes' vectors over stored tiles, lists without a chance left closed."""
    index, queries = _text_index(spark, d), _file_queries(spark, d)
    return _scored(search.tiled_fused_search(queries, search.search_tiles(index, tags=None), LIMIT, query_tags=None))


def q_rrf_fusion(spark, d):
    """Fusion of two of the ranked lists with another constant."""
    return _scored(rrf_fusion(_prefetched(spark, d), ["summary_vec", "content_vec"], LIMIT, k=10))


def q_weighted_fusion(spark, d):
    return _scored(search.fused_search(_q(spark, d), src.chunk_index(spark, d), LIMIT, weights=DEFAULT_WEIGHTS))


def _hits(spark, d):
    index, q = src.chunk_index(spark, d), _q(spark, d)
    found = search.fused_search(q, index, LIMIT, query_tags=None)
    small = search.few_results(q, LIMIT)
    return search.with_payload(found, index, "file_path", "header_path", "summary", "content", small=small)


def q_exclude_path(spark, d):
    kept = search.exclude_path(_hits(spark, d), _q(spark, d))
    return _scored(kept, ("file_path",))


def _formatted(df):
    return df.select(
        "query_id", C("rank").cast("bigint").alias("rank"), "note_path", "title",
        F.round("similarity", 6).alias("similarity"), "excerpt",
    )


def q_format_results(spark, d):
    return _formatted(search.search_notes(_q(spark, d), src.chunk_index(spark, d), LIMIT))


def _hot(spark, d):
    """The rows of the index that the byte budget keeps hot."""
    hot = hot_set(src.access_log(spark, d), HOT_BUDGET).select(C("chunk_id").cast("bigint").alias("vec_id"))
    return src.chunk_index(spark, d).join(hot, "vec_id", "left_semi")


def q_cache_search(spark, d):
    return _scored(search.cache_search(_q(spark, d), _hot(spark, d), LIMIT))


def q_combine_results(spark, d):
    q = _q(spark, d)
    both = combine_results(
        search.cache_search(q, _hot(spark, d), LIMIT), search.fused_search(q, src.chunk_index(spark, d), LIMIT), LIMIT
    )
    return _scored(both, (C("source").cast("bigint").alias("source"),))


def q_hot_set(spark, d):
    return hot_set(src.access_log(spark, d), HOT_BUDGET).select("chunk_id", "last_access", "cached_bytes")


def q_related_notes(spark, d):
    """Notes related to every indexed file: its title and summary are embedded,
    searched in an index of hashed text vectors, and the file itself excluded."""
    return _formatted(search.search_notes(_file_queries(spark, d), _text_index(spark, d), LIMIT))


def _file_queries(spark, d):
    files = _text_index(spark, d).filter(F.endswith("chunk_id", F.lit("-chunk-0")))
    return files.select(
        C("vec_id").alias("query_id"),
        hash_embedding(search.related_query_text(C("header_path"), C("content")), DIM).alias("query_vec"),
        C("file_path").alias("exclude_path"),
    )


def _text_index(spark, d):
    """Documents as an index: content, source and language words as vectors."""
    t = src.table(spark, d, "documents")
    file_no = F.floor(C("doc_id") / 2).cast("bigint")
    path = F.concat(F.lit("n/"), file_no.cast("string"), F.lit(".md"))
    return t.select(
        C("doc_id").alias("vec_id"),
        F.concat(path, F.lit("-chunk-"), (C("doc_id") % 2).cast("string")).alias("chunk_id"),
        path.alias("file_path"),
        F.concat(F.lit("# "), "source").alias("header_path"),
        C("text").alias("content"),
        F.lit("").alias("summary"),
        hash_embedding(C("text"), DIM).alias("content_vec"),
        hash_embedding(F.concat("lang", F.lit(" "), "source"), DIM).alias("summary_vec"),
        hash_embedding(F.concat(F.lit("# "), "source"), DIM).alias("title_vec"),
    )


def q_dimension_lookup(spark, d):
    """Expected size per model against the stored vectors of every label."""
    e = src.table(spark, d, "embeddings")
    models = F.array(*[F.lit(m) for m in [*MODEL_DIMENSIONS, "unknown-model", ""]])
    rows = e.select("label", F.size("embedding").alias("size"), F.explode(models).alias("model"))
    provider = F.when(C("label") % 2 == 0, "ollama").otherwise("openai")
    rows = rows.withColumn("expected", dimension_of(C("model"), provider))
    return rows.groupBy("label", "model", "expected").agg(
        F.count(F.lit(1)).alias("vectors"), F.count_if(C("size") != C("expected")).alias("mismatched")
    ).select(C("label").cast("bigint").alias("label"), "model", C("expected").cast("bigint").alias("expected"), "vectors", "mismatched")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_") and callable(v)}

# ---------------------------------------------------------------- SQL

_BASE = sql.with_(sql.EMB, sql.CHUNK_INDEX, sql.QUERIES)


def _knn(name, vec, k, tags, index="chunk_index", queries="queries"):
    where = "where len(q.tags) = 0 or list_has_any(c.tags, q.tags)" if tags else ""
    return f"""{name} as (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (
    select q.query_id, c.chunk_id, round(coalesce(list_cosine_similarity(q.query_vec, c.{vec}), 0), 9) as score from {queries} q, {index} c {where})
  qualify rank <= {k})"""


def _fuse(name, sets, limit, k=60, weights=None):
    """sets: ordered (cte, label)."""
    weights = weights or [1.0] * len(sets)
    pivot = ", ".join(f"min(case when s = {i} then rank end) as r{i}" for i in range(len(sets)))
    union = " union all ".join(f"select query_id, chunk_id, rank, {i} as s from {cte}" for i, cte in enumerate(sets))
    score = " + ".join(f"coalesce({w}::double / ({k} + r{i}), 0)" for i, w in enumerate(weights))
    first = "coalesce(" + ", ".join(f"case when r{i} is not null then {i * 100000} + r{i} end" for i in range(len(sets))) + ")"
    return f"""{name} as (
  select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, first, chunk_id) as rank from (
    select query_id, chunk_id, {score} as score, {first} as first from (
      select query_id, chunk_id, {pivot} from ({union}) group by query_id, chunk_id))
  qualify rank <= {limit})"""


def _three(tags, index="chunk_index", queries="queries", limit=LIMIT):
    return ",\n".join(
        _knn(n, v, 2 * limit, tags, index, queries) for n, v in (("kc", "content_vec"), ("ks", "summary_vec"), ("kt", "title_vec"))
    )


_CTE = (sql.EMB, sql.CHUNK_INDEX, sql.QUERIES)
_OUT = "select query_id, chunk_id, round(score, 6) as score, rank from "
_FUSED = sql.with_(*_CTE, _three(True), _fuse("fused", ["kc", "ks", "kt"], LIMIT))
_FUSED_ALL = sql.with_(*_CTE, _three(False), _fuse("fused", ["kc", "ks", "kt"], LIMIT))

_HOT = f"""hot_ids as (
  select chunk_id, last_access, cached_bytes from (
    select *, sum(cached_bytes) over (order by last_access desc) as used, max(last_access) over () as newest from (
      select chunk_id, last_access, (2 * length(content) + 8 * len(embedding) + 2 * length(metadata) + 100)::bigint as cached_bytes from access_log))
  where used <= {HOT_BUDGET} or last_access = newest)"""
_HOT_INDEX = "hot as (select c.* from chunk_index c join hot_ids h on h.chunk_id = c.vec_id::varchar)"
_CACHE = (*_CTE, sql.ACCESS, _HOT, _HOT_INDEX, _knn("cached", "content_vec", LIMIT, False, "hot"))

_FORMAT = """select query_id, row_number() over (partition by query_id order by score desc, rank) as rank, file_path as note_path,
  case when header_path <> '' then header_path else regexp_extract(file_path, '([^/]*)$', 1) end as title,
  round(score, 6) as similarity, case when summary <> '' then summary else substr(content, 1, 100) end as excerpt
from (select f.*, c.file_path, c.header_path, c.summary, c.content from fused f join {index} c using (chunk_id) join {queries} q using (query_id)
      where c.file_path <> q.exclude_path)"""


def _hash_vec(name, source):
    """CTE: unit word-count vector per key of ``source(key, text)``."""
    return f"""{name} as (
  select key, list_transform(counts, lambda x: case when norm = 0 then 0 else x / norm end) as v from (
    select key, list(c order by slot) as counts, sqrt(sum(c * c)) as norm from (
      select g.key, g.slot, coalesce(w.c, 0)::double as c
      from (select key, unnest(range(0, {DIM})) as slot from {source}) g left join (
        select key, ('0x' || substr(md5(w), 1, 8))::bigint % {DIM} as slot, count(*)::double as c from (
          select key, unnest(regexp_extract_all(lower(text), '[^ \\n]+')) as w from {source}) group by all) w
      on w.key = g.key and w.slot = g.slot)
    group by key))"""


TEXT_INDEX = ",\n".join(
    (
        "t_content as (select doc_id as key, text from documents)",
        "t_summary as (select doc_id as key, lang || ' ' || source as text from documents)",
        "t_title as (select doc_id as key, '# ' || source as text from documents)",
        _hash_vec("v_content", "t_content"),
        _hash_vec("v_summary", "t_summary"),
        _hash_vec("v_title", "t_title"),
        """text_index as (
  select d.doc_id as vec_id, 'n/' || (doc_id // 2) || '.md-chunk-' || (doc_id % 2) as chunk_id, 'n/' || (doc_id // 2) || '.md' as file_path,
    '# ' || source as header_path, text as content, '' as summary, c.v as content_vec, s.v as summary_vec, t.v as title_vec
  from documents d join v_content c on c.key = doc_id join v_summary s on s.key = doc_id join v_title t on t.key = doc_id)""",
    )
)
_RELATED_BASE = sql.with_(
    TEXT_INDEX,
    "t_query as (select doc_id as key, '# ' || source || chr(10) || text as text from documents where doc_id % 2 = 0)",
    _hash_vec("v_query", "t_query"),
    "text_queries as (select key as query_id, v as query_vec, 'n/' || (key // 2) || '.md' as exclude_path from v_query)",
    _three(False, "text_index", "text_queries"),
    _fuse("fused", ["kc", "ks", "kt"], LIMIT),
)
_RELATED = _RELATED_BASE + _FORMAT.format(index="text_index", queries="text_queries")

_PLANES = ", ".join(
    f"({i}, {[float(x) for x in plane]}::double[])" for i, plane in enumerate(hyperplanes(ANN_DIM, ANN_BANDS, ANN_BITS, ANN_SEED).T)
)
_ANN = f"""planes(p, w) as (values {_PLANES}),
slots as (
  select e.vec_id, p.p // {ANN_BITS} as band, sum(case when list_dot_product(e.v, p.w) >= 0 then 1 << (p.p % {ANN_BITS}) else 0 end) as bucket
  from emb e, planes p group by 1, 2),
near as (
  select distinct q.vec_id as query_id, c.vec_id from slots q join slots c on c.band = q.band and c.bucket = q.bucket),
approx as (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (
    select n.query_id, c.chunk_id, round(list_cosine_similarity(q.query_vec, c.content_vec), 9) as score
    from near n join queries q using (query_id) join chunk_index c on c.vec_id = n.vec_id)
  qualify rank <= {LIMIT})"""



def _unit(v):
    return f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


def _kmeans(rounds):
    """Centres c0, c1, ... of the inverted file; rounds of assignment and means."""
    ctes = [
        f"""ku as materialized (
  select chunk_id as key, ('0x' || substr(md5(chunk_id), 1, 8))::bigint as h, {_unit('content_vec')} as u from chunk_index),
kn as (select count(*) as n from ku),
ks as materialized (select ku.* from ku, kn where h < ceil(least(1, {tiles.SAMPLE_ROWS}::double / n) * 4294967296)),
c0 as materialized (
  select list, list_transform(u, lambda x: round(x, 6)) as c from (select row_number() over (order by h, key) - 1 as list, u from ks), kn
  where list < round({tiles.LISTS_PER_ROOT} * sqrt(n)))"""
    ]
    for r in range(rounds):
        ctes.append(
            f"""m{r} as materialized (
  select list, slot, sum(x) as x from (
    select list, unnest(u) as x, generate_subscripts(u, 1) as slot from (
      select key, u, list from ks, c{r} qualify row_number() over (partition by key order by round(list_dot_product(u, c), 9) desc, list) = 1))
  group by all),
c{r + 1} as materialized (
  select c{r}.list, coalesce(n.c, c{r}.c) as c from c{r} left join (
    select list, list_transform({_unit('s')}, lambda x: round(x, 6)) as c from (select list, list(x order by slot) as s from m{r} group by list)) n using (list))"""
        )
    return ",\n".join(ctes)


_IVF = sql.with_(
    *_CTE,
    _kmeans(tiles.ROUNDS),
    f"""home as materialized (
  select key as chunk_id, list from ku, c{tiles.ROUNDS} qualify row_number() over (partition by key order by round(list_dot_product(u, c), 9) desc, list) = 1),
probe as materialized (
  select query_id, list, row_number() over (partition by query_id order by round(list_dot_product(u, c), 9) desc, list) as probes
  from (select query_id, {_unit('query_vec')} as u from queries), c{tiles.ROUNDS})""",
)
_IVF_TOP = f""",
found as (
  select p.query_id, h.chunk_id, round(list_cosine_similarity(q.query_vec, i.content_vec), 9) as score
  from probe p join home h using (list) join queries q using (query_id) join chunk_index i on i.chunk_id = h.chunk_id
  where p.probes <= ceil({IVF_SHARE} * (select count(*) from c0)))
select query_id, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by found.score desc, chunk_id) as rank
from found qualify rank <= {LIMIT}"""
_IVF_RECALL = ",\n" + _knn("top", "content_vec", LIMIT, False) + """,
hits as (select p.probes, count(*) as hits from top join home h using (chunk_id) join probe p on p.query_id = top.query_id and p.list = h.list group by 1),
sizes as (select list, count(*) as items from home group by 1),
pairs as (select probes, sum(coalesce(items, 0)) as pairs from probe left join sizes using (list) group by 1)
select probes, round(sum(coalesce(hits, 0)) over (order by probes) / sum(hits) over (), 9) as recall,
  round(sum(pairs) over (order by probes) / sum(pairs) over (), 9) as pair_share
from pairs left join hits using (probes)"""

_MODELS = ", ".join(f"('{m}', {n})" for m, n in MODEL_DIMENSIONS.items())

SQL = {
    "vector_topk": sql.with_(*_CTE, _knn("top", "content_vec", 2 * LIMIT, False)) + _OUT + "top",
    "cosine_similarity": _BASE
    + """select chunk_id, round(list_cosine_similarity(content_vec, summary_vec), 6) as content_summary,
  round(list_cosine_similarity(content_vec, title_vec), 6) as content_title, 0.0::double as other_size, 0.0::double as zero_norm from chunk_index""",
    "ann_topk": sql.with_(*_CTE, _ANN) + _OUT + "approx",
    "ivf_topk": _IVF + _IVF_TOP,
    "ivf_recall": _IVF + _IVF_RECALL,
    "tiled_search": _RELATED_BASE + _OUT + "fused",
    "tag_filter": sql.with_(*_CTE, _knn("top", "content_vec", LIMIT, True)) + _OUT + "top",
    "fused_search": _FUSED + _OUT + "fused",
    "rrf_fusion": sql.with_(*_CTE, _three(True), _fuse("fused", ["ks", "kc"], LIMIT, k=10)) + _OUT + "fused",
    "weighted_fusion": sql.with_(*_CTE, _three(True), _fuse("fused", ["kc", "ks", "kt"], LIMIT, weights=[0.4, 0.4, 0.2]))
    + _OUT + "fused",
    "exclude_path": _FUSED_ALL
    + """select f.query_id, c.file_path, f.chunk_id, round(f.score, 6) as score, f.rank from fused f join chunk_index c using (chunk_id)
join queries q using (query_id) where c.file_path <> q.exclude_path""",
    "format_results": _FUSED_ALL + _FORMAT.format(index="chunk_index", queries="queries"),
    "cache_search": sql.with_(*_CACHE) + _OUT + "cached",
    "combine_results": sql.with_(*_CACHE, _three(True), _fuse("fused", ["kc", "ks", "kt"], LIMIT))
    + f"""select query_id, source, chunk_id, round(score, 6) as score, rank from (
  select *, row_number() over (partition by query_id order by score desc, source, in_rank) as rank from (
    select query_id, chunk_id, score, rank as in_rank, 0 as source from cached
    union all
    select query_id, chunk_id, score, rank, 1 from fused f where not exists (
      select 1 from cached c where c.query_id = f.query_id and c.chunk_id = f.chunk_id)))
where rank <= {LIMIT}""",
    "hot_set": sql.with_(sql.ACCESS, _HOT) + "select chunk_id, last_access, cached_bytes from hot_ids",
    "related_notes": _RELATED,
    "dimension_lookup": f"""with models(model, dim) as (values {_MODELS}),
pairs as (
  select label, len(embedding) as size, m.model, case when m.model = '' then 768 else coalesce(k.dim, case when label % 2 = 0 then 768 else 1536 end) end as expected
  from embeddings, (select unnest([{", ".join(f"'{m}'" for m in [*MODEL_DIMENSIONS, 'unknown-model', ''])}]) as model) m left join models k on k.model = m.model)
select label, model, expected, count(*) as vectors, count(*) filter (where size <> expected) as mismatched from pairs group by all""",
}
