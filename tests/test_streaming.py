"""Paragraph detection, debouncing, the sink and the recommender as streams."""

import datetime as dt

import pytest
from conftest import one
from pyspark.sql import functions as F

from quillmesh.functions.vectors import hash_embedding
from quillmesh.streaming import paragraphs as par
from quillmesh.streaming.ambient import start_recommender
from quillmesh.streaming.sink import clear, compact, sink_stats, start_sink, stored_rows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
LONG = "word " * 30
SCHEMA = "editor_id bigint, ts timestamp, content string, cursor int"


def para(spark, text, cursor):
    return one(spark, par.finished_paragraph(F.col("c"), F.lit(cursor)), c=text)


def test_finished_paragraph(spark):
    assert para(spark, "one\n\ntwo \n\n", 11) == "two"
    assert para(spark, "one\n\ntwo \n\n", 5) == "one"
    assert para(spark, "one\n\ntwo", 8) is None
    assert para(spark, "\n\n", 2) == ""
    assert para(spark, "a\n\n\nb\n\n", 7) == "b"
    assert para(spark, "x", 1) is None


def events(spark, rows):
    data = [(e, T0 + dt.timedelta(milliseconds=ms), text, len(text)) for e, ms, text in rows]
    return spark.createDataFrame(data, SCHEMA)


ROWS = [
    (1, 0, LONG + "\n\n"),  # cancelled by the next change after 400 ms
    (1, 400, LONG + "b\n\n"),  # fires: the next change comes exactly 1000 ms later
    (1, 1400, LONG + "c\n\nx"),  # does not qualify, and cancels nothing that is still pending
    (1, 5000, LONG + "d\n\n"),  # fires: nothing follows
    (2, 0, "short\n\n"),  # too short
    (2, 3000, LONG + "e\n\n"),  # cancelled by a change that does not qualify
    (2, 3999, LONG + "e\n\ny"),
]
WANT = [(1, "b"), (1, "d")]


def fired(df):
    return sorted((r["editor_id"], r["paragraph"][-1]) for r in df.collect())


def test_debounce_batch(spark):
    assert fired(par.debounce(events(spark, ROWS))) == WANT
    assert fired(par.debounce(events(spark, ROWS), slice_seconds=1)) == WANT
    assert len(fired(par.debounce(events(spark, ROWS), debounce_ms=0))) == 4


def test_debounce_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for name, rows in (("1", ROWS), ("2", [(9, 3_600_000, "tick")])):
        events(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        query = (
            par.debounce_stream(stream).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    assert fired(spark.read.parquet(out)) == WANT


def test_sink_keeps_last_write_and_survives_replay(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "chunk_id string, content string, seq bigint"
    for n, rows in enumerate(([("a", "1", 1), ("a", "2", 2), ("b", "1", 3)], [("a", "3", 4), ("c", "1", 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        start_sink(stream, log, str(tmp_path / "ck"), interval=None).awaitTermination()
    rows = lambda: sorted((r["chunk_id"], r["content"]) for r in stored_rows(spark, log).collect())
    assert rows() == [("a", "3"), ("b", "1"), ("c", "1")]
    assert tuple(sink_stats(spark, log).first()) == (4, 2, 0)
    # A fresh checkpoint is a run of its own: it adds to the log and overwrites nothing.
    stream = spark.readStream.schema(schema).parquet(src)
    start_sink(stream, log, str(tmp_path / "ck2"), interval=None).awaitTermination()
    assert rows() == [("a", "3"), ("b", "1"), ("c", "1")]
    assert sink_stats(spark, log).first()["flush_count"] == 3
    compact(spark, log, str(tmp_path / "small"))
    assert sorted((r["chunk_id"], r["content"]) for r in stored_rows(spark, str(tmp_path / "small")).collect()) == rows()
    clear(spark, log)
    assert not (tmp_path / "log").exists()


def test_failed_flush_is_counted(spark, tmp_path, monkeypatch):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([("a", "1", 1)], "chunk_id string, content string, seq bigint").coalesce(1).write.parquet(src)

    def run():
        stream = spark.readStream.schema("chunk_id string, content string, seq bigint").parquet(src)
        start_sink(stream, log, str(tmp_path / "ck"), interval=None).awaitTermination()

    with monkeypatch.context() as broken:
        broken.setattr("quillmesh.streaming.sink.write_batch", lambda *_: 1 / 0)
        with pytest.raises(Exception):  # noqa: B017
            run()
    run()
    assert tuple(sink_stats(spark, log).first()) == (1, 1, 1)


def test_ties_of_one_instant(spark):
    rows = [(1, 0, LONG + "a\n\n"), (1, 0, LONG + "bb\n\n"), (1, 0, LONG + "b\n\n")]
    for data in (rows, rows[::-1]):
        assert [r["paragraph"][-2:] for r in par.debounce(events(spark, data)).collect()] == ["bb"]
    named = events(spark, rows).withColumn("n", F.length("content") * -1)
    assert [r["paragraph"][-2:] for r in par.debounce(named, arrival="n").collect()] == [" b"]


def test_recommender(spark, tmp_path):
    embed = lambda t: hash_embedding(t, 16)
    notes = spark.createDataFrame([(f"n{i}.md-chunk-0", f"n{i}.md", w) for i, w in enumerate(["word", "other text", "more"])],
                                  "chunk_id string, file_path string, content string")
    index = notes.select("*", F.lit("").alias("header_path"), F.lit("").alias("summary"),
                         *[embed(F.col("content")).alias(v) for v in ("content_vec", "summary_vec", "title_vec")])
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (ROWS, [(9, 3_600_000, "tick")]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        start_recommender(stream, lambda: index, embed, out, str(tmp_path / "ck"), limit=2).awaitTermination()
    recs = spark.read.parquet(out + "/recommendations").orderBy("query_id", "rank").collect()
    assert [(r["query_id"].split("@")[0], r["rank"]) for r in recs] == [("1", 1), ("1", 2)] * 2
    assert all(r["note_path"] == "n0.md" and r["title"] == "n0.md" for r in recs if r["rank"] == 1)
