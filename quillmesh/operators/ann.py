"""Approximate nearest neighbours by random-hyperplane buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.operators import topk_kernel
from quillmesh.operators.knn import _rank, _sides, _spec, match_tiles

BUCKET_ROWS = 32_768


def hyperplanes(dim: int, bands: int, bits: int, seed: int) -> np.ndarray:
    """Fixed random directions, (dim, bands * bits), a function of the seed."""
    return np.random.default_rng(seed).standard_normal((dim, bands * bits)).round(6)


def with_buckets(df: DataFrame, vec_col: str, planes: np.ndarray, bands: int) -> DataFrame:
    """Add ``buckets``: per band, the number whose bits are the hyperplane sides.

    Vectors of another size than the hyperplanes get no bucket.
    """

    def route(batches):
        for batch in batches:
            yield topk_kernel.add_buckets(batch, vec_col, planes, bands)

    schema = T.StructType([*df.schema.fields, T.StructField("buckets", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(route, schema)


def _slots(df: DataFrame, vec_col: str, planes: np.ndarray, bands: int) -> DataFrame:
    found = with_buckets(df, vec_col, planes, bands)
    return found.select(*df.columns, F.posexplode("buckets").alias("band", "bucket"))


def _pieces(slots: DataFrame, rows: int, name: str) -> DataFrame:
    """Buckets that must be cut, with the number of pieces."""
    counts = slots.groupBy("band", "bucket").count().filter(F.col("count") > rows)
    return F.broadcast(counts.select("band", "bucket", F.ceil(F.col("count") / rows).cast("int").alias(name)))


def ann_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    dim: int,
    bands: int = 16,
    bits: int = 4,
    seed: int = 7,
    query_vec: str = "query_vec",
    item_vec: str = "content_vec",
    query_key: str = "query_id",
    item_key: str = "chunk_id",
    query_tile: int = BUCKET_ROWS,
    item_tile: int = BUCKET_ROWS,
) -> DataFrame:
    """Candidates sharing a bucket in any band, re-ranked by exact cosine.

    Rows move once per band to their bucket; inside a bucket the block kernel
    keeps only ``k`` rows per query.  A crowded bucket is cut into a grid of
    query pieces and item pieces that all meet, so it costs more tasks, not one
    big task, and no candidate is lost.  The tables of crowded buckets have at
    most ``bands * 2**bits`` rows each, which is why they may be broadcast.
    """
    spec = _spec(k, [("ann", query_vec, item_vec)], query_key, item_key, None, None, None, None, None)
    q, i = _sides(queries, items, spec)
    planes = hyperplanes(dim, bands, bits, seed)
    q_slots, i_slots = _slots(q, query_vec, planes, bands), _slots(i, item_vec, planes, bands)
    q_cut, i_cut = _pieces(q_slots, query_tile, "q_n"), _pieces(i_slots, item_tile, "i_n")
    slot = ["band", "bucket"]

    def placed(df, own, own_key, other):
        n_own, n_other = F.coalesce(f"{own}_n", F.lit(1)), F.coalesce(f"{other}_n", F.lit(1))
        return (
            df.join(q_cut, slot, "left")
            .join(i_cut, slot, "left")
            .withColumn(f"{own}_piece", F.pmod(F.xxhash64(own_key), n_own).cast("int"))
            .withColumn(f"{other}_piece", F.explode(F.sequence(F.lit(0), n_other - 1)))
            .drop("q_n", "i_n")
        )

    found = match_tiles(
        placed(q_slots, "q", query_key, "i"), placed(i_slots, "i", item_key, "q"), [*slot, "q_piece", "i_piece"], spec
    )
    once = found.groupBy(query_key, "vec_name", item_key).agg(F.max("score").alias("score"))
    return _rank(once, spec).drop("vec_name")


def recall_at_k(approx: DataFrame, exact: DataFrame, query_key: str = "query_id", item_key: str = "chunk_id") -> DataFrame:
    """Share of exact neighbours found: (expected, found, recall)."""
    hit = approx.select(query_key, item_key, F.lit(1).alias("hit"))
    return (
        exact.select(query_key, item_key)
        .join(hit, [query_key, item_key], "left")
        .agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found"))
        .withColumn("recall", F.col("found") / F.col("expected"))
    )
