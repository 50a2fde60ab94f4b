"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmesh.llm import decontamination, html_text, jaccard_join, language_id, licenses, packing, pii, quality_rules, toxicity, url_rules

LONG = "the word and other thing goes here. " * 20_000
TEXTS = [None, "", "   \n\t ", "One.", LONG, "same text of six words here now", "same text of six words here now", "ünï cödé 😀 text"]
#: Names that operators use inside or return.
CLASH = ["id", "key", "rk", "token", "n", "host", "path", "kept", "score", "piece", "length", "bucket", "_w", "_n", "_rk", "is_url", "group", "hits"]


def rows(spark, name="text", ident="doc_id"):
    data = [(None if i == 3 else i // 2 if i > 4 else i, t) for i, t in enumerate(TEXTS)]
    data.append(data[-1])
    made = spark.createDataFrame(data, f"{ident} bigint, {name} string")
    return made.select("*", *[F.lit(7).alias(c) for c in CLASH if c not in (name, ident)])


def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "same text of six words here now"), (2, "a b")], "item_id bigint, text string")


PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
RULES = [("com", "/", "allow"), ("com", "/", "block"), (None, None, "block")]
NET = language_id.fit(["hello there", "guten tag"] * 4, ["en", "de"] * 4, epochs=1)

OPERATORS = {
    "html": lambda s, d: html_text.extract_text(d.withColumn("url", F.lit(None).cast("string")), "doc_id", "url", "text"),
    "licenses": lambda s, d: licenses.scan(d, licenses.fit([])),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, d.withColumn("label", F.lit(1)))),
    "urls": lambda s, d: url_rules.match_urls(d, s.createDataFrame(RULES, "host string, path string, verdict string"), "doc_id", "text"),
    "pii": lambda s, d: pii.find_pii(d),
    "contamination": lambda s, d: decontamination.find_contamination(d, bench(s)),
    "quality": lambda s, d: quality_rules.quality(d),
    "language": lambda s, d: language_id.identify(d, NET),
    "near": lambda s, d: jaccard_join.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, name):
    data = rows(spark)
    out = OPERATORS[name](spark, data).collect()
    assert len(out) == data.count()
    assert len(OPERATORS[name](spark, data.limit(0)).collect()) == 0
    # repeated rows have equal results
    last = [str(r) for r in out if r[0] == 3]
    assert len(last) >= 2 and len(set(last)) <= 2


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, name, stage):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    data = rows(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    out = stage(spark, data, str(tmp_path))
    assert name == "packing" or out.dtypes == data.dtypes
    got = out.collect()
    if name == "packing":
        assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    if name == "personal_data":
        assert len(got) == len(TEXTS) + 1
    if name == "near_duplicates":
        # one row of each group: both six-word texts are one, the two equal rows at the end are one
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 0), (False, 1), (False, 2), (False, 2), (False, 3), (False, 4), (True, 0)]
    if name == "decontamination":
        assert len(got) == len(TEXTS) + 1 - 2
    assert stage(spark, data.limit(0), str(tmp_path)).count() == 0


def test_clashing_names_in_rules(spark):
    rules = spark.createDataFrame([("com", "/a", "block", 1, "x")], "host string, path string, verdict string, id int, key string")
    urls = spark.createDataFrame([(1, "http://x.com/a/b"), (1, "http://x.com/a/b"), (2, None), (3, "x.com/a")], "page_id bigint, url string")
    got = sorted(tuple(r) for r in url_rules.match_urls(urls, rules, ranges=3).collect())
    assert got == [(1, "x.com", "/a/b", "com/a", "block")] * 2 + [(2, "", "", None, "allow"), (3, "", "", None, "allow")]


def test_no_benchmark_no_labels(spark):
    data = rows(spark)
    assert not any(r.contaminated for r in decontamination.find_contamination(data, bench(spark).limit(0)).collect())
    assert decontamination.drop_contaminated(data, bench(spark).limit(0)).count() == data.count()
    assert toxicity.train(data, data.withColumn("label", F.lit(None).cast("int"))) == [(-1, -2.0)]
    assert language_id.train(data.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in language_id.identify(data, None).collect()} == {"und"}


def test_pieces_of_every_row(spark):
    got = packing.pack(rows(spark), *PATHS).collect()
    assert sum(r.piece == 0 for r in got) == len(TEXTS) + 1
    assert packing.pack(rows(spark).limit(0), *PATHS).count() == 0
