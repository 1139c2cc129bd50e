"""Markdown directory scan (A1, A2).

One row per ``*.md`` file under a directory (recursively), read whole. Paths
of scheme ``file`` are read by the source of :mod:`quire.sources.files`, which
finds every file; other stores by Spark's own text source, which alone knows
their credentials but leaves out zero-byte files and names that begin with
``_`` or ``.``. ``reader`` chooses either of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.files import read_files


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hpath


def qualified_dir(spark: SparkSession, path: str) -> str:
    """Fully qualified form of ``path`` (``file:/...``, ``s3a://...``);
    raises ``FileNotFoundError`` when it does not exist."""
    fs, hpath = _fs_path(spark, path)
    if not fs.exists(hpath):
        raise FileNotFoundError(f"Directory not found: {path}")
    return fs.makeQualified(hpath).toString().rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs_path(spark, path)
    return fs.exists(hpath)


def qualified(spark: SparkSession, path: str) -> str:
    """Fully qualified form of ``path``, whether it exists or not."""
    fs, hpath = _fs_path(spark, path)
    return fs.makeQualified(hpath).toString().rstrip("/")


def _reader(spark: SparkSession, fmt: str):
    return (spark.read.format(fmt)
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.md"))


def decoded_path(col) -> "F.Column":
    """``_metadata.file_path`` is URL-encoded; ``+`` is literal there."""
    return F.url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))


def _by_files(base: str, reader: str | None) -> bool:
    if reader not in (None, "files", "spark"):
        raise ValueError(f"unknown reader: {reader}")
    return reader == "files" or (reader is None and base.startswith("file:"))


def scan_markdown(spark: SparkSession, directory: str, relative: bool = True,
                  reader: str | None = None) -> DataFrame:
    """``source_file, text``: every ``*.md`` under ``directory``.

    ``source_file`` is the path relative to ``directory`` (the reference's
    metadata), or the file name with ``relative=False``. ``reader`` is
    ``"files"`` (every file; zero-byte ones have an empty text), ``"spark"``
    (see above) or None: ``"files"`` where the path is of scheme ``file``.
    """
    base = qualified_dir(spark, directory)
    if _by_files(base, reader):
        df, path = read_files(spark, base), F.col("source_file")
        rel = path
    else:
        df = _reader(spark, "text").option("wholetext", "true").load(directory) \
            .withColumnRenamed("value", "text")
        path = decoded_path(F.col("_metadata.file_path"))
        rel = F.when(path.startswith(base + "/"), F.substr(path, F.lit(len(base) + 2))) \
            .otherwise(F.regexp_extract(path, r"([^/]*)$", 1))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return df.select((rel if relative else name).alias("source_file"), "text")


def list_markdown(spark: SparkSession, directory: str, reader: str | None = None) -> DataFrame:
    """``source_file, length`` of the files of :func:`scan_markdown`;
    contents are not read."""
    base = qualified_dir(spark, directory)
    if _by_files(base, reader):
        return read_files(spark, base, contents=False)
    df = _reader(spark, "binaryFile").load(directory)
    path = F.col("path")  # binaryFile paths are not URL-encoded
    rel = F.when(path.startswith(base + "/"), F.substr(path, F.lit(len(base) + 2))) \
        .otherwise(F.regexp_extract(path, r"([^/]*)$", 1))
    return df.select(rel.alias("source_file"), "length")


def count_markdown_files(spark: SparkSession, directory: str, reader: str | None = None) -> int:
    """Number of ``*.md`` files of :func:`list_markdown`, counted by Spark."""
    return list_markdown(spark, directory, reader).count()
