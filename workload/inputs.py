"""Inputs that Spark derives from the driver tables (same rules as inputs_sql)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")

    def rewrite(line: Column, i: Column) -> Column:
        n = i + C("doc_id")
        link = F.concat(line, F.lit(" [[topics/Concept_"), (C("doc_id") % 50).cast("string"), F.lit("|alias]]"))
        level = (F.lit(1) + F.floor(n / 5) % 3).cast("int")
        return (
            F.when(
                (C("doc_id") % 4 != 0) & (n % 5 == 0),
                F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.substring(line, 1, 40)),
            )
            .when(n % 13 == 3, F.lit("```py"))
            .when(n % 13 == 6, F.lit("```"))
            .when(n % 13 == 8, F.lit("![[img.png]]"))
            .when(n % 13 == 9, F.lit("a | b"))
            .when(n % 13 == 10, F.lit("--- | ---"))
            .when(n % 13 == 11, F.lit("c | d"))
            .when((C("doc_id") % 3 == 1) & (n % 4 == 1), link)
            .otherwise(line)
        )

    body = F.array_join(F.transform(F.split("text", "\n", -1), rewrite), "\n")
    front = F.when(C("doc_id") % 7 == 0, F.lit("---\nstatus: x\n---\n")).otherwise(F.lit(""))
    return d.select(
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), C("doc_id").cast("string"), F.lit(".md")).alias("note_path"),
        F.concat(F.lit("doc_"), C("doc_id").cast("string")).alias("title"),
        F.concat(front, body).alias("content"),
        F.lit("2024-01-15 00:00:00Z").cast("timestamp").alias("mtime"),
        F.array("lang", "source").alias("tags"),
    )


def long_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of a hundred documents each, with some hundred lines up."""
    one = F.struct("doc_id", "content")
    joined = notes(spark, sf_dir).groupBy(F.floor(C("doc_id") / 100).alias("n")).agg(F.array_sort(F.collect_list(one)).alias("parts"))
    return joined.select(
        F.concat(F.lit("long/"), C("n").cast("string"), F.lit(".md")).alias("note_path"),
        F.array_join(F.transform("parts", lambda x: x["content"]), "\n").alias("content"),
    )


def note_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    link = lambda n: F.concat(F.lit("[[_me/Concept_"), n.cast("string"), F.lit("]]"))
    doc = C("doc_id")
    return d.select(
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), doc.cast("string"), F.lit(".md")).alias("note_path"),
        F.when(doc % 5 == 0, F.lit(None).cast("array<string>"))
        .when(doc % 5 == 1, F.array().cast("array<string>"))
        .when(doc % 5 == 2, F.array(link(doc % 50), F.concat(F.lit("[[Loose_"), (doc % 9).cast("string"), F.lit("]]"))))
        .otherwise(F.array(link(doc % 50), link((doc * 7) % 50)))
        .alias("me_concepts"),
        F.when(doc % 11 == 0, F.lit("bad"))
        .when(doc % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("2024-01-"), F.lpad((doc % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00.000Z")))
        .alias("me_indexed_at"),
        F.lit("2024-01-15 00:00:00Z").cast("timestamp").alias("mtime"),
    )


def proposed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_path, ord, name): names to add to every fourth-residue-free note."""
    d = note_state(spark, sf_dir)
    names = F.when(
        C("doc_id") % 4 != 0,
        F.array(
            F.concat(F.lit("Concept_"), (C("doc_id") % 50).cast("string")),
            F.concat(F.lit("New_"), (C("doc_id") % 7).cast("string")),
            F.concat(F.lit("New_"), (C("doc_id") % 3).cast("string")),
        ),
    )
    return d.select("note_path", F.posexplode(names).alias("ord", "name"))


def embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    e = table(spark, sf_dir, "embeddings")
    return e, e.count()


def _lookup(e: DataFrame, name: str) -> DataFrame:
    return e.select(C("vec_id").alias(f"_{name}"), C("embedding").alias(name))


def _attach(df: DataFrame, e: DataFrame, name: str, key: Column) -> DataFrame:
    return df.withColumn(f"_{name}", key).join(_lookup(e, name), f"_{name}").drop(f"_{name}")


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = embeddings(spark, sf_dir)
    v = C("vec_id")
    file_no = F.floor(v / 5).cast("bigint")
    df = e.withColumnRenamed("embedding", "content_vec")
    df = _attach(df, e, "summary_vec", (v + 1) % n)
    df = _attach(df, e, "title_vec", file_no * 5)
    path = F.concat(F.lit("f/doc_"), file_no.cast("string"), F.lit(".md"))
    return df.select(
        "vec_id",
        F.concat(path, F.lit("-chunk-"), (v % 5).cast("string")).alias("chunk_id"),
        path.alias("file_path"),
        F.when(v % 2 == 0, F.concat(F.lit("# D"), file_no.cast("string"))).otherwise(F.lit("")).alias("header_path"),
        F.concat(F.lit("c"), v.cast("string")).alias("content"),
        F.when(v % 3 != 0, F.concat(F.lit("s"), v.cast("string"))).otherwise(F.lit("")).alias("summary"),
        F.array(F.concat(F.lit("t"), C("label").cast("string")), F.concat(F.lit("g"), (v % 3).cast("string"))).alias("tags"),
        "content_vec",
        "summary_vec",
        "title_vec",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = C("vec_id")
    none = F.array().cast("array<string>")
    return e.select(
        v.alias("query_id"),
        C("embedding").alias("query_vec"),
        F.when(v % 2 == 0, none).otherwise(F.array(F.lit("g0"), F.lit("g1"))).alias("tags"),
        F.concat(F.lit("f/doc_"), F.floor(v / 5).cast("bigint").cast("string"), F.lit(".md")).alias("exclude_path"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = embeddings(spark, sf_dir)
    v = C("vec_id")
    df = _attach(e.withColumnRenamed("embedding", "concept_vec"), e, "concept_summary_vec", (v + 100) % n)
    name = F.concat(F.lit("Concept_"), v.cast("string"))
    return df.select(
        name.alias("concept"),
        F.concat(F.lit("about "), v.cast("string")).alias("summary"),
        F.concat(F.lit("[[_me/"), name, F.lit("]]")).alias("link"),
        F.lit(1).cast("bigint").alias("note_count"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("first_seen_at"),
        F.lit("2024-01-02 00:00:00").cast("timestamp").alias("last_used_at"),
        "concept_vec",
        "concept_summary_vec",
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three proposed concepts per embedding: strict, loose, new and copied ones."""
    e, n = embeddings(spark, sf_dir)
    b, c = C("vec_id"), C("copy")
    df = e.withColumnRenamed("embedding", "own").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    for name, shift in (("far", 200), ("side", 7), ("tilt", 13), ("about", 100), ("noise", 320)):
        df = _attach(df, e, name, (b + shift) % n)
    mix = lambda x, y, w: F.zip_with(x, y, lambda p, q: p.cast("double") + w * q.cast("double"))
    e_far = F.when(b % 4 == 0, F.lit(0.1) * (c + 1)).when(b % 4 == 1, F.lit(0.6)).otherwise(F.lit(1.2))
    name_vec = F.when(
        b % 4 == 2, mix(mix(C("own"), C("side"), F.lit(-1.0)), C("tilt"), F.lit(0.05) * c)
    ).otherwise(mix(C("own"), C("far"), e_far))
    f_noise = F.when((b % 4 == 2) | ((b % 4 == 1) & (c > 0)), F.lit(3.0)).otherwise(F.lit(0.3))
    ord_ = b * 3 + c
    return df.select(
        ord_.alias("ord"),
        F.concat(F.lit("f/doc_"), F.floor(b / 5).cast("bigint").cast("string"), F.lit(".md")).alias("note_path"),
        F.concat(F.lit("Term_"), ord_.cast("string")).alias("name"),
        F.concat(F.lit("why "), (ord_ % 11).cast("string")).alias("reason"),
        (((ord_ * 37) % 100) / F.lit(100.0)).alias("confidence"),
        name_vec.alias("name_vec"),
        mix(C("about"), C("noise"), f_noise).alias("reason_vec"),
    )


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def metadata_answers(notes_df: DataFrame) -> DataFrame:
    """One model answer per note, cycling through well- and ill-formed shapes."""
    d = C("doc_id")
    full = _text(
        '{"summary":" about ', d, ' ","tags":["t', d % 3, '","u"],"category":"读书笔记",'
        '"concepts":[{"name":"Alpha ', d % 5, '","confidence":0.9},{"name":"Beta","confidence":0.5}]}',
    )
    shapes = [
        full,
        _text("```json\n", full, "\n```"),
        _text("sorry, no JSON for ", d),
        _text('{"summary":"x","tags":["a"," ","b","a",null,"c","d","e","f', d % 4, '"],"concepts":[]}'),
        _text('{"summary":"","tags":[],"category":"other ', d, '","concepts":null}'),
        _text('{"summary":"strings","concepts":[" Gamma ","gamma","Delta ', d % 6, '","",3,null]}'),
        _text(
            '{"summary":"mixed","concepts":[{"name":"Eps","confidence":null},{"name":"eps","confidence":"0.4"},'
            '{"name":"Zeta"},{"name":"zeta","confidence":0.', d % 10, '},{"name":5},{"confidence":1},"Eta"]}',
        ),
        F.lit("{}"),
    ]
    pick = shapes[-1]
    for n in range(len(shapes) - 2, -1, -1):
        pick = F.when(d % 8 == n, shapes[n]).otherwise(pick)
    return notes_df.withColumn("response", pick)


def span_answers(notes_df: DataFrame) -> DataFrame:
    """One span answer per note, cycling through regular and odd shapes."""
    d = C("doc_id")
    n = F.size(F.split("content", "\n", -1))
    half = F.floor(n / 2).cast("bigint")
    shapes = [
        _text(
            '{"chunks":[{"title":"first ', d, '","startLine":1,"endLine":', half,
            '},{"title":"second","startLine":', half + 1, ',"endLine":', n, "}]}",
        ),
        _text(
            '{"chunks":[{"title":"late","startLine":', half, ',"endLine":', n,
            '},{"title":" early ","startLine":1,"endLine":', half + 1, "}]}",
        ),
        _text(
            '{"chunks":[{"title":"","startLine":1,"endLine":1},{"title":"two","startLine":2,"endLine":2},'
            '{"title":"rest","startLine":3,"endLine":', n, "}]}",
        ),
        F.lit(
            '{"chunks":[{"title":null,"startLine":"1","endLine":"2"},{"title":"snake","start_line":3,"end_line":null},'
            '{"startLine":null,"start_line":4,"endLine":9},{"title":"missing","startLine":2}]}'
        ),
        F.lit(
            '{"chunks":[{"title":"rev","startLine":5,"endLine":2},{"title":"big","startLine":7,"endLine":9999},'
            '{"title":"zero","startLine":0,"endLine":-3}]}'
        ),
        F.when(d % 12 == 11, F.lit("no spans today")).otherwise(F.lit('{"chunks":[]}')),
    ]
    pick = shapes[-1]
    for k in range(len(shapes) - 2, -1, -1):
        pick = F.when(d % 6 == k, shapes[k]).otherwise(pick)
    return notes_df.withColumn("response", pick)


def editor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growing editor text per conversation, one change per turn."""
    return shape_events(table(spark, sf_dir, "conversations"))


def shape_events(turns: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    gap = (
        F.when((C("conv_id") + C("turn")) % 3 == 0, F.lit(400))
        .when((C("conv_id") + C("turn")) % 3 == 1, F.lit(1000))
        .otherwise(F.lit(2500))
    )
    content = F.concat(F.array_join(F.collect_list("text").over(w), "\n\n"), F.lit("\n\n"))
    start = F.lit("2024-01-01 00:00:00Z").cast("timestamp")
    return (
        turns.withColumn("content", content)
        .withColumn("ms", F.sum(gap).over(w))
        .select(
            C("conv_id").alias("editor_id"),
            "turn",
            F.timestamp_millis(F.unix_millis(start) + C("ms")).alias("ts"),
            "content",
            (F.length("content") - F.when(C("turn") % 3 == 2, 1).otherwise(0)).cast("int").alias("cursor"),
        )
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = embeddings(spark, sf_dir)
    v = C("vec_id")
    return e.select(
        v.cast("string").alias("chunk_id"),
        ((v * 7919) % n).alias("last_access"),
        F.concat(F.lit("c"), v.cast("string")).alias("content"),
        "embedding",
        F.concat(F.lit('{"id":'), v.cast("string"), F.lit("}")).alias("metadata"),
    )
