"""Nearest-neighbour joins on named vectors (exact cosine top-k).

Three plans, chosen by the rows and bytes of each side, which the executors count first:

* up to ``broadcast_rows`` queries (and 128 MB of them): the queries are broadcast and the item table
  is scanned once, without moving any item row; every task emits at most ``k``
  rows per query and vector, and a window merges them;
* more queries, but at most ``BROADCAST_ITEMS`` items (a concept registry, say):
  the items are broadcast and the queries are scanned in place; every query sees
  all items in one task, so nothing is shuffled or merged;
* otherwise: the queries are cut into hash tiles, several per core and of bounded size, and
  every tile streams all items in the order of their keys, so that a query has its ``k`` rows in one task.
  Items are packed into blocks and stored once; tiles read the stored blocks, and nothing is copied for them.  Both sides
  are computed once.  Tiles come from hashes of unique keys, so no source, folder or tag can make a tile large.

All are exact and give identical rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmesh.operators import topk_kernel
from quillmesh.session import discard, materialize, materialize_observed

# Tasks receive the kernel by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(topk_kernel)

BROADCAST_QUERIES = 2048
BROADCAST_ITEMS = 65_536
BROADCAST_BYTES = 128 * 1024 * 1024
# Tiles of queries hold at most about this much vector data (within the row bounds).
TILE_BYTES = 64 * 1024 * 1024
TILE_ROWS = (1024, 65_536)
TILES_PER_CORE = 3
# Queries that are worth one more copy of the items, however many cores a session claims to have.
LEAST_ROWS = 2048

VectorPair = tuple[str, str, str]


def _spec(
    k, vectors, query_key, item_key, query_tags=None, item_tags=None, min_score=None, query_order=None, item_order=None,
    query_group=None, item_group=None, query_floor=None, settle=False,
):
    if k < 1:
        raise ValueError("k must be at least 1")
    return {
        "k": k,
        "vectors": [tuple(v) for v in vectors],
        "query_key": query_key,
        "item_key": item_key,
        "query_tags": query_tags,
        "item_tags": item_tags,
        "min_score": min_score,
        "query_order": query_order,
        "item_order": item_order,
        "query_group": query_group,
        "item_group": item_group,
        "query_floor": query_floor,
        "settle": settle,
    }


def _needed(df: DataFrame, names: Sequence[str | None]) -> DataFrame:
    return df.select(*dict.fromkeys(n for n in names if n))


def _sides(queries: DataFrame, items: DataFrame, spec: dict) -> tuple[DataFrame, DataFrame]:
    q = _needed(queries, [spec["query_key"], *[v[1] for v in spec["vectors"]], spec["query_tags"], spec["query_order"], spec["query_group"], spec["query_floor"]])
    i = _needed(items, [spec["item_key"], *[v[2] for v in spec["vectors"]], spec["item_tags"], spec["item_order"], spec["item_group"]])
    return q, i


def _schema(q: DataFrame, i: DataFrame, spec: dict) -> T.StructType:
    return T.StructType(
        [
            T.StructField(spec["query_key"], q.schema[spec["query_key"]].dataType),
            T.StructField("vec_name", T.StringType()),
            T.StructField(spec["item_key"], i.schema[spec["item_key"]].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )


def _rank(found: DataFrame, spec: dict) -> DataFrame:
    # One exchange on the query key serves this ranking and any later fusion.
    found = found.repartition(F.col(spec["query_key"]))
    w = W.partitionBy(spec["query_key"], "vec_name").orderBy(F.desc("score"), spec["item_key"])
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= spec["k"])


def match_tiles(q_routed: DataFrame, i_routed: DataFrame, tile: Sequence[str], spec: dict) -> DataFrame:
    """Evaluate every pair of query and item tiles that share the tile key."""
    schema = _schema(q_routed, i_routed, spec)
    arrow = to_arrow_schema(schema)
    # Both sides may read the same table; renaming keeps their columns apart in the co-group.
    own = [c for c in i_routed.columns if c not in tile]
    i_routed = i_routed.select(*tile, *[F.col(c).alias(f"_item_{c}") for c in own])

    def evaluate(q_table, i_table):
        found = []
        if q_table.num_rows and i_table.num_rows:
            i_table = i_table.rename_columns([c.removeprefix("_item_") for c in i_table.schema.names])
            i_table = topk_kernel.in_key_order(i_table, spec)
            blocks = topk_kernel.placed_blocks(i_table, spec)
            search = topk_kernel.Search(q_table, spec)
            for block in blocks:
                search.visit(block)
            found = list(search.result(i_table.column(spec["item_key"]).combine_chunks()))
        return topk_kernel.as_table(found, arrow)

    return q_routed.groupBy(*tile).cogroup(i_routed.groupBy(*tile)).applyInArrow(evaluate, schema)


class Size(NamedTuple):
    """Rows and bytes of the needed columns of one side, counted on the executors."""

    rows: int
    bytes: int

    def tile(self) -> int:
        """Rows per tile."""
        return min(TILE_ROWS[1], max(TILE_ROWS[0], TILE_BYTES * max(1, self.rows) // max(1, self.bytes)))


def _measures(df: DataFrame) -> tuple[Column, Column]:
    """Rows, and bytes of all columns."""

    def width(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            inner = field.dataType.elementType
            if isinstance(inner, T.StringType):
                one = F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 4)
            else:
                one = F.size(c).cast("bigint") * 8
        elif isinstance(field.dataType, T.StringType):
            one = F.octet_length(c).cast("bigint") + 4
        else:
            one = F.lit(8).cast("bigint")
        return F.coalesce(one, F.lit(0).cast("bigint"))

    total = sum((width(f) for f in df.schema.fields), F.lit(0).cast("bigint"))
    return F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("b")


def _size(df: DataFrame) -> Size:
    found = df.agg(*_measures(df)).first()
    return Size(found["n"], found["b"])


def stored_side(df: DataFrame, name: str) -> tuple[DataFrame, Size]:
    """One side, computed once and stored, and its size; vectors may be dear to compute."""
    stored, found = materialize_observed(df, name, *_measures(df))
    return stored, Size(found["n"], found["b"])


def tasks_for(df: DataFrame, rows: int, most: int = TILE_ROWS[1], least: int = LEAST_ROWS) -> int:
    """Query tiles: several per core, of bounded size; small ones would move more than they compare."""
    wide = TILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-rows // most), min(wide, rows // least))


def _packed(i: DataFrame, order: Sequence[str], most: int | None = None, vec_cols: Sequence[str] = ()) -> DataFrame:
    """All rows of ``i`` in ``order`` as packed blocks, with the place ``_at`` of each block.

    With ``most``, equal vectors beyond so many in a task become NULL (``topk_kernel.packed``).
    """
    keys = [F.col(c).asc_nulls_last() for c in order]

    def pack(batches):
        yield from topk_kernel.packed(batches, most, vec_cols)

    blocks = i.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pack, "_block binary")
    return blocks.withColumn("_at", F.monotonically_increasing_id())


#: File systems that tasks open through Arrow.
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs")


def stored_files(blocks: DataFrame) -> list[str] | None:
    """Files of a stored table in the order of its partitions, as Arrow opens them; None if it cannot."""
    files = sorted(blocks.inputFiles(), key=os.path.basename)
    if any((f.split(":", 1)[0] if ":" in f.split("/", 1)[0] else "") not in SCHEMES for f in files):
        return None
    return ["file://" + f.removeprefix("file:") if f.startswith("file:/") and not f.startswith("file://") else f.replace("s3a://", "s3://", 1) for f in files]


def streamed(q: DataFrame, i: DataFrame, tiles: int, tile: Column, order: Sequence[str], work: Callable, schema, spec: dict) -> DataFrame:
    """Rows of ``q`` in ``tiles`` partitions by ``tile``; every partition then reads all rows of ``i`` in ``order``.

    ``work(batches, files)`` gets the queries of a tile, and the files of the blocks that ``topk_kernel.packed`` made of ``i``, stored once.
    Items are streamed, so that a task holds its queries only.  Where tasks cannot open the shared folder, ``files`` is None and blocks
    come through an exchange, once per tile: batches have ``_side`` (0: q, first; 1: i), the columns of ``q`` under the prefix ``q_``, and ``_block``.
    """
    blocks = materialize(_packed(i, order, *topk_kernel.alike(spec)), "blocks")
    files, number = stored_files(blocks), F.pmod(tile, F.lit(tiles)).cast("int")
    if files is not None:
        return q.repartitionById(tiles, number).mapInArrow(lambda batches: work(batches, files), schema)
    left = q.select(F.lit(0).alias("_side"), number.alias("_tile"), *[F.col(c).alias(f"q_{c}") for c in q.columns])
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    right = blocks.select(F.lit(1).alias("_side"), every.alias("_tile"), "_at", "_block")
    both = left.unionByName(right, allowMissingColumns=True).repartitionById(tiles, F.col("_tile"))
    return both.sortWithinPartitions("_side", "_at").drop("_tile", "_at").mapInArrow(lambda batches: work(batches, None), schema)


def _tiled(q: DataFrame, i: DataFrame, spec: dict, q_size: Size, query_tile: int | None) -> DataFrame:
    tiles = -(-q_size.rows // query_tile) if query_tile else tasks_for(q, q_size.rows, q_size.tile())
    q_names = q.columns

    def work(batches, files):
        yield from topk_kernel.stream_search(batches, q_names, spec, files=files)

    return streamed(q, i, max(1, tiles), F.xxhash64(spec["query_key"]), [spec["item_key"]], work, _schema(q, i, spec), spec)


def _scan_queries(q: DataFrame, i: DataFrame, items, spec: dict, rows: int) -> DataFrame:
    items = topk_kernel.without_repeated(topk_kernel.in_key_order(items, spec), *topk_kernel.alike(spec))
    shared = q.sparkSession.sparkContext.broadcast(items)

    def scan(batches):
        import pyarrow as pa

        table = shared.value
        blocks = list(topk_kernel.placed_blocks(table, spec))
        keys = table.column(spec["item_key"]).combine_chunks()
        for batch in batches:
            yield from topk_kernel.search_table(pa.Table.from_batches([batch]), keys, blocks, spec)

    # a small file is one partition, but its pairs are many
    return q.repartition(tasks_for(q, rows, least=256), spec["query_key"]).mapInArrow(scan, _schema(q, i, spec))


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    vectors: Sequence[VectorPair] = (("content_vec", "query_vec", "content_vec"),),
    query_key: str = "query_id",
    item_key: str = "chunk_id",
    query_tags: str | None = None,
    item_tags: str | None = None,
    min_score: float | None = None,
    query_order: str | None = None,
    item_order: str | None = None,
    query_group: str | None = None,
    item_group: str | None = None,
    query_floor: str | None = None,
    settle: bool = False,
    broadcast_rows: int = BROADCAST_QUERIES,
    broadcast_items: int = BROADCAST_ITEMS,
    query_tile: int | None = None,
    item_tile: int | None = None,  # items are streamed; kept for callers that give it
) -> DataFrame:
    """Top ``k`` items per query for each (name, query column, item column).

    Tags filter the items before ranking (any shared tag; no tags = no filter).
    With the order columns, a query only sees items of a smaller order; with the
    group columns, only items of another group (NULL differs from everything).
    Vectors that are NULL, of another size or hold no finite number are never hits.
    ``query_floor`` is a column with a score that the caller knows to be reached: worse items need not be found.  With ``settle``,
    better ones need not be the best: it is enough that one is found.  Few queries see all items in any case.
    Returns ``(query_key, vec_name, item_key, score, rank)``.
    """
    spec = _spec(
        k, vectors, query_key, item_key, query_tags, item_tags, min_score, query_order, item_order, query_group, item_group, query_floor, settle
    )
    q, i = _sides(queries, items, spec)
    # rows first: they are counted without computing vectors
    if q.select(query_key).count() > broadcast_rows or _size(q).bytes > BROADCAST_BYTES:
        (q, q_size), (i, i_size) = stored_side(q, "queries"), stored_side(i, "items")
        if i_size.rows <= broadcast_items and i_size.bytes <= BROADCAST_BYTES:
            found = _scan_queries(q, i, i.toArrow(), spec, q_size.rows)
        else:
            found = _rank(_tiled(q, i, spec, q_size, query_tile), spec)
        discard(i)
        return found

    shared = q.sparkSession.sparkContext.broadcast(topk_kernel.prepare_queries(q.toArrow(), spec))

    def scan(batches):
        yield from topk_kernel.search(shared.value, topk_kernel.item_blocks(batches, spec), spec)

    return _rank(i.mapInArrow(scan, _schema(q, i, spec)), spec)
