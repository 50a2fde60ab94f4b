"""The stream that keeps an index fresh, and the reader of note folders."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators.chunking import chunk_id, chunk_notes
from quillmesh.sources import notes as source
from quillmesh.sources import vault
from quillmesh.streaming.refresh import start_refresh
from quillmesh.streaming.sink import stored_rows

SCHEMA = "note_path string, content string, version bigint"
FIELDS = ["chunk_id", "content", "header_path", "start_pos", "end_pos", "start_line", "end_line"]


def text(r, n):
    return "\n".join(r.choice(["# Head", "## Sub", "words " * r.randint(1, 12), "", "more text here"]) for _ in range(n))


class Vault:
    """Note versions on disk, and what the index should hold."""

    def __init__(self, spark, folder):
        self.spark, self.src, self.log, self.ck, self.now = spark, f"{folder}/in", f"{folder}/log", f"{folder}/ck", {}

    def push(self, rows, **options):
        for path, content, version in rows:
            if path is not None and version is not None and version >= self.now.get(path, ("", -1))[1]:
                self.now[path] = (content, version)
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.src)
        stream = self.spark.readStream.schema(SCHEMA).parquet(self.src)
        query = start_refresh(stream, self.log, self.ck, max_chars=60, interval=None, **options)
        query.awaitTermination()

    def check(self):
        live = [(p, c) for p, (c, _) in self.now.items() if c is not None]
        chunks = chunk_notes(self.spark.createDataFrame(live, "note_path string, content string"), 60)
        want = chunks.withColumn("chunk_id", chunk_id(F.col("note_path"), F.col("index"))).select(*FIELDS)
        got = stored_rows(self.spark, self.log).select(*FIELDS)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    def written(self):
        return self.spark.read.parquet(self.log).count()


def test_stream_equals_batch_after_edits_deletions_and_restarts(spark, tmp_path):
    r, v = random.Random(3), Vault(spark, tmp_path)
    v.push([(f"n{i}.md", text(r, 12), 1) for i in range(12)] + [(None, "no path", 1), ("n0.md", "no version", None)])
    v.check()
    for version in (2, 3):  # every push is a new start from the checkpoint
        changes = [(f"n{i}.md", r.choice([None, " \n", text(r, 9), "short"]), version) for i in r.sample(range(14), 6)]
        v.push(changes)
        v.check()
    # an older version that comes late changes nothing, nor does a repeated one
    before = v.written()
    v.push([("n1.md", "late", 0), ("n2.md", *v.now["n2.md"])])
    v.check()
    assert v.written() == before
    # a deleted note comes back with a newer version only
    v.push([("n3.md", None, 7)])
    v.push([("n3.md", "old", 6)])
    v.check()
    v.push([("n3.md", "new", 8), ("n3.md", "newer", 9)])
    v.check()


def test_only_changed_chunks_are_emitted(spark, tmp_path):
    v = Vault(spark, tmp_path)
    parts = ["# A\n" + "a " * 20, "# B\n" + "b " * 20, "# C\n" + "c " * 20]
    v.push([("n.md", "\n".join(parts), 1)])
    first = v.written()
    v.push([("n.md", "\n".join([parts[0], parts[1].replace("b", "x"), parts[2]]), 2)])
    v.check()
    assert v.written() == first + 1
    v.push([("n.md", parts[0], 3)])
    v.check()
    assert {r.chunk_id for r in spark.read.parquet(v.log).filter("deleted").collect()} == {"n.md-chunk-1", "n.md-chunk-2"}


def test_shape_sees_changes_only(spark, tmp_path):
    v = Vault(spark, tmp_path)
    v.push([("n.md", "some text", 1)], shape=lambda c: c.withColumn("n", F.length("content")))
    assert [(r.chunk_id, r.n) for r in stored_rows(spark, v.log).collect()] == [("n.md-chunk-0", 9)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none") != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# folders of notes ------------------------------------------------------------------------------------------


def make(folder, files):
    for path, data in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{path}") or folder, exist_ok=True)
        with open(f"{folder}/{path}", "wb") as f:
            f.write(data)


FILES = {
    "a.md": b"top", "empty.md": b"", "x/b.md": "ünï".encode(), "x/y/z/deep.md": b"d\n", "x/y/z/empty.md": b"", "_me/Concept.md": b"c",
    "sp ace/with space.md": b"s", "x/not.txt": b"n", ".trash/gone.md": b"g", "x/.hidden.md": b"h", "bad.md": b"\xff\xfeok", "x/dot.name.md": b"",
}


@pytest.mark.parametrize("scheme", ["", "file://", "file:"])
def test_every_note_of_a_folder(spark, tmp_path, scheme):
    make(tmp_path, FILES)
    got = {r.note_path: (r.title, r.content) for r in source.read_vault(spark, f"{scheme}{tmp_path}/").collect()}
    want = {p for p in FILES if p.endswith(".md") and "/." not in f"/{p}"}
    assert set(got) == want
    assert got["x/dot.name.md"] == ("dot.name", "") and got["empty.md"] == ("empty", "") and got["x/b.md"] == ("b", "ünï")
    assert got["bad.md"][1] == "\ufffd\ufffdok"


def test_an_empty_folder_and_none(spark, tmp_path):
    assert source.read_vault(spark, str(tmp_path)).count() == 0
    assert source.read_vault(spark, f"{tmp_path}/none").count() == 0


def test_the_driver_opens_few_folders(tmp_path, monkeypatch):
    make(tmp_path, {f"{a}/{b}/{c}.md": b"x" for a in range(6) for b in range(6) for c in range(20)})
    opened = []
    monkeypatch.setattr(vault, "_children", lambda fs, folder, real=vault._children: opened.append(folder) or real(fs, folder))
    reader = vault.VaultReader(str(tmp_path), 5)
    parts = reader.partitions()
    assert len(opened) == 1 and len(parts) == 5  # the root alone
    listed = [p for part in parts for batch in reader.read(part) for p in batch.column("note_path").to_pylist()]
    assert sorted(listed) == sorted(f"{a}/{b}/{c}.md" for a in range(6) for b in range(6) for c in range(20))
    deep = vault.VaultReader(str(tmp_path), 500).partitions()
    assert sum(len(p.folders) for p in deep) == 1 + 6 + 36


def test_other_file_systems_go_to_spark(spark, tmp_path):
    make(tmp_path, FILES)
    assert not vault.reachable("viewfs://store/x") and vault.reachable("/x") and vault.reachable("hdfs://h/x")
    plain = {r.note_path: bytes(r.content) for r in source._by_file_source(spark, str(tmp_path)).collect()}
    assert plain["a.md"] == b"top" and plain["empty.md"] == b""


def test_written_notes_are_read_back(spark, tmp_path):
    rows = [("a/b.md", "text"), ("c.md", None), ("d/e/f.md", ""), ("a/g.md", "ü")]
    notes = spark.createDataFrame(rows, "note_path string, content string").repartition(3)
    assert vault.write_notes(notes, str(tmp_path)) == 4
    assert vault.write_notes(notes, str(tmp_path)) == 4  # a second run replaces the same files
    got = {(r.note_path, r.content) for r in source.read_vault(spark, str(tmp_path)).collect()}
    assert got == {(p, c or "") for p, c in rows}
    for path in ("../x.md", "/x.md", "a/../../x.md"):
        with pytest.raises(Exception, match="outside"):
            vault.write_notes(spark.createDataFrame([(path, "x")], "note_path string, content string"), str(tmp_path))
