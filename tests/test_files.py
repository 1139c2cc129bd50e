"""The markdown file source and sink against the folder itself."""

import os
from pathlib import Path

import pytest

from quire.plans.ingest import ingest_directory
from quire.sources import files
from quire.sources.files import MarkdownReader, read_files, write_files


def _tree(root: Path) -> dict[str, bytes]:
    made = {"a.md": b"one", "_b.md": b"two", ".c.md": b"", "sub dir/d+1%20.md": "é日".encode(),
            ".git/e.md": b"five\r\nlines\n", "_x/y/f.md": b"\xffbad", "g.MD": b"no", "h.txt": b"no",
            "i.md.bak": b"no", "deep/" * 12 + "j.md": b"ten"}
    for name, raw in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    return {n: raw for n, raw in made.items() if n.endswith(".md")}


def test_every_file_is_read(spark, tmp_path):
    want = _tree(tmp_path)
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    (tmp_path / "broken.md").symlink_to(tmp_path / "nothing")
    (tmp_path / "folder.md").mkdir()
    want["link.md"] = b"one"
    got = read_files(spark, str(tmp_path)).collect()
    assert {r.source_file: (r.length, r.text) for r in got} == {
        n: (len(raw), raw.decode("utf-8", "replace")) for n, raw in want.items()}
    assert len(got) == len(want)
    for path in (f"file:{tmp_path}", f"file://{tmp_path}", f"{tmp_path}/"):
        assert read_files(spark, path, contents=False).count() == len(want)
    found = [p for p in tmp_path.rglob("*.md") if p.is_file()]
    assert len(found) == len(want)


def test_pages_share_the_files_of_a_folder(spark, tmp_path):
    for i in range(500):
        (tmp_path / f"n{i}.md").write_text(str(i))
    df = read_files(spark, str(tmp_path), page_files=60)
    assert df.rdd.getNumPartitions() == 9
    assert sorted(int(r.text) for r in df.collect()) == list(range(500))
    pages = MarkdownReader(str(tmp_path), True, 60).partitions()
    assert all(len(vars(p)) == 3 for p in pages)  # no names held on the driver
    assert read_files(spark, str(tmp_path), contents=False).columns == ["source_file", "length"]


def test_texts_leave_in_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BATCH_BYTES", 1000)
    for i in range(20):
        (tmp_path / f"{i}.md").write_text("x" * 300)
    reader = MarkdownReader(str(tmp_path), True, files.PAGE_FILES)
    sizes = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(sizes) == 20 and max(sizes) == 4


def test_empty_folder(spark, tmp_path):
    assert read_files(spark, str(tmp_path)).collect() == []


def test_write_and_read(spark, tmp_path):
    rows = [("a/_b c.md", "text"), ("d.md", None), (".e/f.md", "é\r\n"), ("h.txt", "no markdown")]
    df = spark.createDataFrame(rows, "source_file string, text string").repartition(3)
    for _ in range(2):  # a repeated task changes nothing
        assert write_files(df, str(tmp_path / "out")) == 4
    got = {r.source_file: r.text for r in read_files(spark, str(tmp_path / "out")).collect()}
    assert got == {n: t or "" for n, t in rows[:3]}
    assert write_files(df.limit(0), str(tmp_path / "none")) == 0
    with pytest.raises(Exception, match="a row without a path"):
        write_files(spark.createDataFrame([(None, "x")], df.schema), str(tmp_path / "bad"))


def test_ingest_counts_hidden_and_empty_files(spark, tmp_path):
    src = tmp_path / "src"
    want = _tree(src)
    got = ingest_directory(spark, str(src), str(tmp_path / "coll"), "all")
    assert got["files_processed"] == len(want) == 7
    assert got["chunks_added"] == sum(1 for raw in want.values() if raw)
    assert os.path.isdir(tmp_path / "coll" / "all")


def test_new_ids_are_broadcast_by_their_bytes(spark, tmp_path, monkeypatch):
    """Both ways of probing insert each id once; long ids count as they are."""
    from pyspark.sql import functions as F

    from quire.sources import collection as C

    hinted = []
    real = F.broadcast
    monkeypatch.setattr(C.F, "broadcast", lambda df: hinted.append(1) or real(df))
    chunks = spark.range(20).select(*[
        (F.concat(F.lit("x" * 1000), "id") if f.name == "id" else F.lit("s") if
         f.name == "source_file" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in C.CHUNK_SCHEMA.fields])
    root = str(tmp_path)
    C.add_chunks(spark, chunks.limit(5), root, "long", broadcast_limit=10_000)
    assert hinted == [1]
    assert C.add_chunks(spark, chunks, root, "long", broadcast_limit=10_000) \
        == {"chunks_produced": 20}
    assert hinted == [1]
    assert C.read_collection(spark, root, "long").count() == 20
