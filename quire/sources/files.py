"""Markdown files as a Python data source (A1, A2, B3), and its sink.

Spark's own file sources leave out names that begin with ``_`` or ``.`` and
zero-byte files. This source reads them: the driver walks the folders and only
counts their files; a folder is cut into pages by a hash of the file names, and
each page is a partition whose task lists the folder again and reads its own
files. Neither names nor texts pass through the driver, and a lost task is
simply read again. Files must be reachable from every executor by the path
given (a shared mount, or any store that ``pyarrow.fs`` opens).
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader,
                                    InputPartition)

SUFFIX = ".md"
PAGE_FILES = 10_000      # files of one partition, about
BATCH_BYTES = 32 << 20   # text of one Arrow batch, about
_LISTERS = 16            # folders listed at once on the driver
SLICE_FILES = 2_000      # files of one task of a stream, at most
SLICE_BYTES = 4 << 20    # and their bytes, about


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path`` (a URI or a local path) and the path in it."""
    uri = urlsplit(path)
    if uri.scheme == "file":
        path = unquote(uri.path) if path.startswith("file://") else path[len("file:"):]
    if uri.scheme in ("", "file"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    store, root = pafs.FileSystem.from_uri(path)
    return store, root.rstrip("/")


def _list(store: pafs.FileSystem, folder: str) -> tuple[list[str], list[pafs.FileInfo]]:
    """Folders in ``folder`` (links to folders are not followed) and its
    markdown files."""
    found = store.get_file_info(pafs.FileSelector(folder))
    local = isinstance(store, pafs.LocalFileSystem)
    folders = [f.path for f in found if f.type == pafs.FileType.Directory
               and not (local and os.path.islink(f.path))]
    return folders, [f for f in found if f.type == pafs.FileType.File
                     and f.base_name.endswith(SUFFIX)]


@dataclass
class Page(InputPartition):
    folder: str
    number: int
    pages: int

    def holds(self, name: str) -> bool:
        return zlib.crc32(name.encode("utf-8", "surrogateescape")) % self.pages == self.number


class MarkdownReader(DataSourceReader):
    def __init__(self, path: str, contents: bool, page_files: int):
        self.path, self.contents, self.page_files = path, contents, page_files

    def partitions(self) -> list[Page]:
        store, root = open_store(self.path)
        pages, level = [], [root]
        with ThreadPoolExecutor(_LISTERS) as pool:
            while level:
                below = []
                for folder, (folders, files) in zip(
                        level, pool.map(lambda f: _list(store, f), level)):
                    below += folders
                    n = -(-len(files) // self.page_files)
                    pages += [Page(folder, i, n) for i in range(n)]
                level = below
        # A scan without partitions is not asked for at all: one empty page.
        return pages or [Page(root, 0, 1)]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        store, root = open_store(self.path)
        names, sizes, texts, held = [], [], [], 0

        def batch() -> pa.RecordBatch:
            columns = {"source_file": pa.array(names, pa.string()),
                       "length": pa.array(sizes, pa.int64())}
            if self.contents:
                columns["text"] = pa.array(texts, pa.string())
            return pa.RecordBatch.from_pydict(columns)
        for file in _list(store, page.folder)[1]:
            if not page.holds(file.base_name):
                continue
            names.append(file.path[len(root.rstrip("/")) + 1:])
            sizes.append(file.size)
            if self.contents:
                with store.open_input_stream(file.path) as stream:
                    raw = stream.readall()
                texts.append(raw.decode("utf-8", "replace"))
                held += len(raw)
            if held >= BATCH_BYTES or len(names) >= self.page_files:
                yield batch()
                names, sizes, texts, held = [], [], [], 0
        if names:
            yield batch()


class MarkdownFiles(DataSource):
    """``spark.read.format("markdown_files").load(folder)``: every ``*.md``
    file below a folder. Options: ``contents`` (``false`` leaves the texts
    unread), ``pageFiles``."""

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def _contents(self) -> bool:
        return self.options.get("contents", "true").lower() != "false"

    def schema(self) -> str:
        return "source_file string, length long" + ", text string" * self._contents()

    def reader(self, schema) -> MarkdownReader:
        return MarkdownReader(self.options["path"], self._contents(),
                              int(self.options.get("pageFiles", PAGE_FILES)))


def read_files(spark: SparkSession, directory: str, contents: bool = True,
               page_files: int = PAGE_FILES) -> DataFrame:
    """``source_file`` (relative to ``directory``), ``length`` in bytes and,
    with ``contents``, ``text`` of every markdown file."""
    spark.dataSource.register(MarkdownFiles)
    return spark.read.format("markdown_files") \
        .option("contents", str(contents).lower()) \
        .option("pageFiles", str(page_files)).load(directory)


# ---------------------------------------------------------------------------
# The same files as a stream
# ---------------------------------------------------------------------------
@dataclass
class Slice(InputPartition):
    batch: int
    number: int


_FOUND = pa.schema([("source_file", pa.string()), ("length", pa.int64())])


def _hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) \
        or name.endswith("._COPYING_")


class MarkdownStreamReader(DataSourceStreamReader):
    """Batch ``n`` is what the file ``n.arrow`` in the folder ``log`` names:
    the files found that no earlier one names. Each record batch of it is the
    work of one task, which alone reads the texts. A batch that is run again
    reads the same files."""

    def __init__(self, path: str, log: str):
        self.path, self.log, self.seen = path, log, []

    def _log(self, batch: int) -> tuple[pafs.FileSystem, str]:
        store, log = open_store(self.log)
        return store, f"{log}/{batch}.arrow"

    def _logged(self, batch: int) -> pa.Table:
        store, path = self._log(batch)
        with store.open_input_file(path) as file:
            return pa.ipc.open_file(file).read_all()

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        while (log := self._log(len(self.seen) + 1)) and \
                log[0].get_file_info(log[1]).type == pafs.FileType.File:
            self.seen.append(self._logged(len(self.seen) + 1)["source_file"])
        found = self._found()
        if self.seen and found.num_rows:
            known = pa.chunked_array([c for names in self.seen for c in names.chunks], pa.string())
            found = found.filter(pc.invert(pc.is_in(found["source_file"], value_set=known)))
        if found.num_rows:
            self._write(found.combine_chunks(), len(self.seen) + 1)
            self.seen.append(found["source_file"])
        return {"batch": len(self.seen)}

    def _found(self) -> pa.Table:
        """All files there are, by path and length; as with Spark's own stream,
        hidden names are left out and links to folders followed."""
        store, root = open_store(self.path)
        local = isinstance(store, pafs.LocalFileSystem)

        def listed(folder: str) -> tuple[list[str], pa.Table]:
            folders, files = [], []
            for f in store.get_file_info(pafs.FileSelector(folder)):
                if _hidden(f.base_name):
                    continue
                if f.type == pafs.FileType.Directory:
                    if not (local and os.path.islink(f.path) and
                            os.path.realpath(folder).startswith(os.path.realpath(f.path))):
                        folders.append(f.path)
                elif f.type == pafs.FileType.File and f.base_name.endswith(SUFFIX):
                    files.append(f)
            return folders, pa.table([pa.array([f.path[len(root) + 1:] for f in files], pa.string()),
                                      pa.array([f.size for f in files], pa.int64())], schema=_FOUND)
        found, level = [_FOUND.empty_table()], [root.rstrip("/")]
        with ThreadPoolExecutor(_LISTERS) as pool:
            while level:
                below = []
                for folders, files in pool.map(listed, level):
                    below += folders
                    found.append(files)
                level = below
        return pa.concat_tables(found)

    def _write(self, found: pa.Table, batch: int) -> None:
        store, path = self._log(batch)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out, pa.ipc.new_file(out, _FOUND) as writer:
            start = held = 0
            for i, size in enumerate(found["length"].to_pylist()):
                held += size
                if held >= SLICE_BYTES or i + 1 - start >= SLICE_FILES or i + 1 == found.num_rows:
                    writer.write_table(found.slice(start, i + 1 - start),
                                       max_chunksize=SLICE_FILES)
                    start, held = i + 1, 0
        store.move(part, path)

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        slices = []
        for batch in range(start["batch"] + 1, end["batch"] + 1):
            store, path = self._log(batch)
            with store.open_input_file(path) as file:
                slices += [Slice(batch, i)
                           for i in range(pa.ipc.open_file(file).num_record_batches)]
        return slices

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        store, path = self._log(part.batch)
        with store.open_input_file(path) as file:
            names = pa.ipc.open_file(file).get_batch(part.number)["source_file"].to_pylist()
        store, root = open_store(self.path)
        read, texts, held = [], [], 0
        for name in names:
            with store.open_input_stream(f"{root.rstrip('/')}/{name}") as stream:
                raw = stream.readall()
            read.append(name)
            texts.append(raw.decode("utf-8", "replace"))
            held += len(raw)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pydict({"source_file": read, "text": texts})
                read, texts, held = [], [], 0
        if read:
            yield pa.RecordBatch.from_pydict({"source_file": read, "text": texts})


class MarkdownStream(DataSource):
    """``spark.readStream.format("markdown_stream").load(folder)``: the ``*.md``
    files below a folder, each once. Option ``log``: a folder of the stream's
    own, kept as long as its checkpoint, for the names that were found."""

    @classmethod
    def name(cls) -> str:
        return "markdown_stream"

    def schema(self) -> str:
        return "source_file string, text string"

    def streamReader(self, schema) -> MarkdownStreamReader:
        return MarkdownStreamReader(self.options["path"], self.options["log"])


def write_files(df: DataFrame, directory: str, path_col: str = "source_file",
                text_col: str = "text") -> int:
    """Write one file for every row below ``directory``, each under its own
    relative path; the number written. A null text makes a zero-byte file; a
    null path raises. A repeated task writes the same bytes again; of rows
    with one path any one stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(directory)
        made: set[str] = set()
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{root}/{name}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(path) as stream:
                    stream.write((text or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})
    path = F.coalesce(F.col(path_col), F.raise_error(F.lit("a row without a path")))
    return df.select(path, F.col(text_col)).mapInArrow(run, "n long") \
        .agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
