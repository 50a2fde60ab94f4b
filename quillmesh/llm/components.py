"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import discard, materialize

#: Rounds until the algorithm gives up; each one at least halves the paths that are left, about.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is its least node.

    Alternates two steps until nothing changes: every node sends its larger neighbours to the least
    node that it knows (large star), then its smaller ones (small star).  A round is a
    grouping and a join over edges and is written to the shared folder, the round before deleted; the number of edges
    never grows.  Groupings sum up before they move; the joins have a hub's edges on one key, which adaptive
    execution splits.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, now = now, materialize(now.where("a <> b").distinct(), "edges")
        discard(last)
        facts = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if facts == before:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            found = materialize(stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
            discard(now)
            return found
        before = facts
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
