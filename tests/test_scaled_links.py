"""Notes related by links, without opening the whole list of a link."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import concepts as con


def test_a_link_of_all_notes_opens_a_few_of_them(spark):
    df = spark.range(3000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("note_path"), F.array(F.lit("all"), F.concat(F.lit("l"), (F.col("id") % 1500).cast("string"))).alias("me_concepts"))
    assert con._best_shared(df, df, 2).count() <= 3000 * 3 * 3


@pytest.mark.parametrize("most", [6, 2])
def test_first_related_notes_equal_the_whole_list(spark, monkeypatch, most):
    monkeypatch.setattr(con, "SUBSET_LINKS", most)
    rng = np.random.default_rng(5)
    data = [(f"p{int(rng.integers(0, 70)):02d}", [f"l{int(x)}" for x in rng.integers(0, 9, int(rng.integers(0, 8)))]) for _ in range(90)]
    data += [(None, ["l1"]), ("nulls", [None, "l2", "l2"]), ("none", None), ("empty", [])]
    df = spark.createDataFrame(data, "note_path string, me_concepts array<string>")
    get = lambda r: sorted((x["target_path"], x["rank"], x["note_path"], x["shared"], x["shared_count"]) for x in r.collect())
    assert get(con.related_by_concept(df, df, 3)) == get(con.related_by_concept(df, df).where("rank <= 3"))
