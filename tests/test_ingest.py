"""Directory scan, ingest into collections, add-if-absent, streaming ingest."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from quire.operators import retrieve
from quire.operators.embed import embed
from quire.plans.ingest import ingest_directory
from quire.sources.collection import count, get, read_collection
from quire.sources.markdown import count_markdown_files, list_markdown, scan_markdown
from quire.streaming.ingest import stream_ingest


def test_scan_finds_all_markdown(spark):
    assert count_markdown_files(spark, FIXTURES) == 6
    sizes = {r.source_file: r.length for r in list_markdown(spark, FIXTURES).collect()}
    assert {"plain.md", "with_parts.md", "bare.md"} <= set(sizes) and sizes["empty.md"] == 0
    texts = {r.source_file: r.text for r in scan_markdown(spark, FIXTURES).collect()}
    assert texts["empty.md"] == "" and "long_note.md" in texts
    by_spark = {r.source_file: r.text for r in
                scan_markdown(spark, FIXTURES, reader="spark").collect()}
    assert by_spark == {k: v for k, v in texts.items() if v}


def test_scan_nested_and_relative(spark, tmp_path):
    nested = tmp_path / "sub dir" / "deeper"
    nested.mkdir(parents=True)
    (tmp_path / "root.md").write_text("# Root")
    (nested / "inner.md").write_text("# Inner")
    (tmp_path / "skip.txt").write_text("no")
    got = sorted(r.source_file for r in scan_markdown(spark, str(tmp_path)).collect())
    assert got == ["root.md", "sub dir/deeper/inner.md"]


def test_scan_empty_and_missing(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert count_markdown_files(spark, str(tmp_path / "empty")) == 0
    with pytest.raises(FileNotFoundError):
        scan_markdown(spark, str(tmp_path / "nonexistent"))


def test_ingest_fixtures(spark, tmp_path):
    root = str(tmp_path / "coll")
    res = ingest_directory(spark, FIXTURES, root, "test_collection")
    assert res["files_processed"] == 6
    assert res["chunks_added"] > 0
    assert res["collection_name"] == "test_collection"
    coll = read_collection(spark, root, "test_collection")
    assert count(coll).collect()[0][0] == res["chunks_added"]
    # rerun: nothing is inserted twice
    again = ingest_directory(spark, FIXTURES, root, "test_collection")
    assert again["chunks_added"] == res["chunks_added"]
    assert read_collection(spark, root, "test_collection").count() == res["chunks_added"]


def test_ingest_missing_and_empty_dir(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest_directory(spark, str(tmp_path / "nonexistent"), str(tmp_path), "x")
    (tmp_path / "empty").mkdir()
    res = ingest_directory(spark, str(tmp_path / "empty"), str(tmp_path / "c"), "empty_test")
    assert res == {"files_processed": 0, "chunks_added": 0}
    assert read_collection(spark, str(tmp_path / "c"), "empty_test").count() == 0


def test_metadata_and_search(spark, tmp_path):
    root = str(tmp_path / "coll")
    ingest_directory(spark, FIXTURES, root, "meta_test")
    coll = read_collection(spark, root, "meta_test")
    metas = get(coll, ["metadatas"]).collect()
    plain = [m for m in metas if m.source_file == "plain.md"]
    assert plain and plain[0].metadata["title"] == "Plain Note"
    assert "alpha" in plain[0].metadata["tags"]
    full = [m for m in metas if m.source_file == "all_fields.md"][0].metadata
    assert full["id"] == "2024-05-20_field-check" and full["type"] == "long_read"
    assert full["author"] == "Pat Writer" and full["url"] == "https://example.org/field-check"
    q = embed(spark.createDataFrame([(1, "parts")], "query_id long, question string"), "question")
    res = retrieve.retrieve(coll, q, n_results=1).collect()
    assert len(res) == 1 and res[0].source_file is not None


def test_no_chunk_option(spark, tmp_path):
    root = str(tmp_path / "coll")
    ingest_directory(spark, FIXTURES, root, "no_chunk_test", no_chunk=True)
    coll = read_collection(spark, root, "no_chunk_test")
    plain = coll.filter(F.col("source_file") == "plain.md").collect()
    assert len(plain) == 1 and plain[0].total_chunks == 1
    assert coll.filter(F.col("source_file") == "long_note.md").count() == 1


def test_stem_collision_first_writer_wins(spark, tmp_path):
    src = tmp_path / "src"
    (src / "a").mkdir(parents=True)
    (src / "b").mkdir()
    (src / "a" / "same.md").write_text("first version")
    (src / "b" / "same.md").write_text("second version")
    root = str(tmp_path / "coll")
    res = ingest_directory(spark, str(src), root, "collide")
    assert res["chunks_added"] == 2
    rows = read_collection(spark, root, "collide").collect()
    assert [(r.id, r.source_file, r.document) for r in rows] == [("same_0", "a/same.md",
                                                                  "first version")]


def test_stream_ingest_is_incremental(spark, tmp_path):
    src = tmp_path / "incoming"
    src.mkdir()
    shutil.copy(os.path.join(FIXTURES, "plain.md"), src / "plain.md")
    root = str(tmp_path / "coll")
    ckpt = str(tmp_path / "ckpt")
    stream_ingest(spark, str(src), root, "live", ckpt).awaitTermination(120)
    first = read_collection(spark, root, "live").count()
    assert first == 1
    shutil.copy(os.path.join(FIXTURES, "long_note.md"), src / "long_note.md")
    stream_ingest(spark, str(src), root, "live", ckpt).awaitTermination(120)
    ids = sorted(r.id for r in read_collection(spark, root, "live").collect())
    assert ids[0].startswith("long_note_") and "plain_0" in ids
    assert len(ids) == len(set(ids))


def test_ask_one_question(spark, tmp_path):
    from quire.plans.ask import ask_one

    root = str(tmp_path / "coll")
    ingest_directory(spark, FIXTURES, root, "ask_test")
    r = ask_one(spark, root, "ask_test", "What does the note say about windows?").collect()[0]
    assert r.system.startswith("You are a helpful assistant")
    assert "Here is relevant context from the knowledge base:" in r.system
    assert [(m.role, m.content) for m in r.messages] == [
        ("user", "What does the note say about windows?")]
    missing = ask_one(spark, root, "no_such_collection", "hello?").collect()[0]
    assert "Here is relevant context" not in missing.system


def test_job_entry_points(spark, tmp_path, capsys):
    import json

    from quire.__main__ import main

    root = str(tmp_path / "coll")
    assert main(["ingest", FIXTURES, root, "cli"]) == 0
    stats = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert stats["files_processed"] == 6 and stats["collection_name"] == "cli"
    assert main(["ask", root, "cli", "parts?", "--n-results", "2"]) == 0
    req = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert req["max_tokens"] == 2048 and req["messages"] == [{"role": "user", "content": "parts?"}]
    assert main(["ingest", str(tmp_path / "missing"), root, "cli"]) == 1


def test_stream_ingest_makes_few_tasks_of_many_files(spark, tmp_path, monkeypatch):
    """The tasks of a batch follow the bytes of its files, not their number,
    and the caller's session keeps its settings."""
    from quire.streaming import ingest  # noqa: PLC0415

    src = tmp_path / "many"
    src.mkdir()
    for i in range(64):
        (src / f"n{i}.md").write_text(f"note {i}")
    seen = []
    chunks = ingest.articles_to_chunks

    def counted(batch, **options):
        seen.append((batch.rdd.getNumPartitions(),
                     batch.sparkSession.conf.get("spark.sql.session.timeZone")))
        return chunks(batch, **options)
    monkeypatch.setattr(ingest, "articles_to_chunks", counted)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        stream_ingest(spark, str(src), str(tmp_path / "coll"), "many", str(tmp_path / "ckpt")) \
            .awaitTermination(120)
        assert spark.conf.get("spark.sql.files.openCostInBytes") == str(64 << 20)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert seen and seen[0][1] == "UTC"
    assert seen[0][0] <= max(4, spark.sparkContext.defaultParallelism)
    assert read_collection(spark, str(tmp_path / "coll"), "many").count() == 64


def test_stream_reads_files_in_few_tasks_and_each_once(spark, tmp_path, monkeypatch):
    """Files are read by the source of the library (Spark's own opens each
    with a configuration of its own), each once over all runs; hidden ones
    stay out as before, and a batch that was planned but not run is run."""
    from pyspark.sql.datasource import DataSourceStreamReader

    from quire.sources.files import MarkdownStreamReader
    from quire.streaming import ingest

    src, ckpt, root = tmp_path / "in", str(tmp_path / "ckpt"), str(tmp_path / "coll")
    (src / "sub dir").mkdir(parents=True)
    (src / ".git").mkdir()
    for name in ("a+1%20.md", "sub dir/b.md", "_no.md", ".git/no.md", "empty.md", "c.txt"):
        (src / name).write_text("" if name == "empty.md" else f"text of {name}")
    (src / "sub dir/up").symlink_to(src, target_is_directory=True)
    stream_ingest(spark, str(src), root, "n", ckpt).awaitTermination(120)
    assert not os.path.exists(f"{ckpt}/sources/0")  # where Spark's source keeps its names
    assert sorted(r.source_file for r in read_collection(spark, root, "n").collect()) == [
        "a+1%20.md", "sub dir/b.md"]
    (src / "a+1%20.md").write_text("changed")  # a file seen is not read again
    (src / "d.md").write_text("later")
    reader = MarkdownStreamReader(f"file://{src}", f"file://{ckpt}/found-files")
    assert isinstance(reader, DataSourceStreamReader)
    assert reader.latestOffset() == {"batch": 2} == reader.latestOffset()
    (part,) = reader.partitions({"batch": 1}, {"batch": 2})
    assert [b.to_pydict() for b in reader.read(part)] == [
        {"source_file": ["d.md"], "text": ["later"]}]
    texts = []
    chunks = ingest.articles_to_chunks
    monkeypatch.setattr(ingest, "articles_to_chunks", lambda batch, **kw:
                        texts.extend(r.text for r in batch.collect()) or chunks(batch, **kw))
    for _ in range(2):
        stream_ingest(spark, str(src), root, "n", ckpt).awaitTermination(120)
    assert texts == ["later"]
    assert read_collection(spark, root, "n").count() == 3
    # Limited triggers keep Spark's source, and its checkpoints go on with it.
    stream_ingest(spark, str(src), root, "m", f"{ckpt}2", max_files_per_trigger=2) \
        .awaitTermination(120)
    (src / "e.md").write_text("last")
    stream_ingest(spark, str(src), root, "m", f"{ckpt}2").awaitTermination(120)
    assert read_collection(spark, root, "m").count() == 4
    assert os.path.exists(f"{ckpt}2/sources/0") and not os.path.exists(f"{ckpt}2/found-files")


def test_append_without_repeats_moves_no_text_but_once(spark, tmp_path, monkeypatch):
    """Unique new chunks are not joined, so only the range shuffle of the
    append moves their texts; repeats and stored ids are still left out."""
    from pyspark.sql import functions as F

    from quire.sources import collection as C

    seen = []
    real = C.first_writer
    monkeypatch.setattr(C, "first_writer", lambda *a: seen.append(a[1].count()) or real(*a))
    frame = spark.range(6).select(*[
        (F.col("id").cast("string") if f.name == "id" else F.concat(F.lit("f"), "id") if
         f.name == "source_file" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in C.CHUNK_SCHEMA.fields])
    C.add_chunks(spark, frame, str(tmp_path), "c")
    assert seen == [] and read_collection(spark, str(tmp_path), "c").count() == 6
    more = frame.unionByName(frame.withColumn("id", F.concat(F.lit("n"), F.col("id").cast("int") % 2)))
    C.add_chunks(spark, more, str(tmp_path), "c")
    got = {r.id: r.source_file for r in read_collection(spark, str(tmp_path), "c").collect()}
    assert seen == [2] and len(got) == 8 and (got["n0"], got["n1"]) == ("f0", "f1")
