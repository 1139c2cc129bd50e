"""Incremental ingest (B4): new markdown files -> collection, as a
Structured Streaming query.

The source (that of :mod:`quire.sources.files` for paths of scheme ``file``,
else Spark's own) tracks which files it has seen beside the checkpoint; each
micro-batch is chunked, embedded and appended with the same add-if-absent
rule as the batch job, so a replayed batch after a failure inserts nothing
twice (the anti-join makes the sink idempotent). No streaming state is kept
by Spark itself, so no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.ingest import articles_to_chunks
from quire.session import checkpoint_dir
from quire.sources.collection import add_chunks, create_collection
from quire.sources.files import MarkdownStream
from quire.sources.markdown import decoded_path, path_exists, qualified, qualified_dir

# What opening a file counts for when files are put together into tasks. Spark's
# default, 4 MB, makes a task of every 32 articles.
OPEN_COST_BYTES = 128 << 10


def _stream_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` in which many small files make
    up few tasks: the file source lists the files of every batch one by one,
    by default in up to 10,000 tasks, and reads them under its session."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST_BYTES))
    session.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism",
                     str(4 * spark.sparkContext.defaultParallelism))
    return session


def markdown_stream(spark: SparkSession, directory: str,
                    max_files_per_trigger: int | None = None,
                    log: str | None = None) -> DataFrame:
    """Streaming ``source_file, text`` of ``*.md`` files in ``directory``.

    With ``log``, a folder for the names found so far, paths of scheme ``file``
    are listed once by the driver and read by few tasks; Spark's source opens
    every file through a job configuration of its own, which takes longer than
    to chunk it. It remains for other stores and limited triggers.
    """
    base = qualified_dir(spark, directory)
    if log and base.startswith("file:") and not max_files_per_trigger:
        spark.dataSource.register(MarkdownStream)
        return spark.readStream.format("markdown_stream").option("log", log).load(base)
    reader = (spark.readStream.format("text").option("wholetext", "true")
              .option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.load(directory)
    path = decoded_path(F.col("_metadata.file_path"))
    rel = F.when(path.startswith(base + "/"), F.substr(path, F.lit(len(base) + 2))) \
        .otherwise(F.regexp_extract(path, r"([^/]*)$", 1))
    return df.select(rel.alias("source_file"), F.col("value").alias("text"))


def stream_ingest(spark: SparkSession, directory: str, root: str, name: str,
                  checkpoint: str | None = None, *, available_now: bool = True,
                  max_files_per_trigger: int | None = None, **options):
    """Start the incremental ingest; returns the ``StreamingQuery``.

    ``checkpoint`` defaults to a folder under the session's shared
    ``spark.checkpoint.dir``. ``options`` are those of the batch job
    (``no_chunk``, ``frontmatter_mode``, ``dims``, ...), see
    :func:`quire.plans.ingest.articles_to_chunks`.
    """
    create_collection(spark, root, name)
    session = _stream_session(spark)
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/stream_ingest_{name}"

    def write_batch(batch: DataFrame, _batch_id: int) -> None:
        add_chunks(batch.sparkSession, articles_to_chunks(batch, **options), root, name)

    # A checkpoint of Spark's own source goes on with it.
    log = qualified(spark, f"{ckpt}/found-files")
    if path_exists(spark, f"{ckpt}/sources/0") or not log.startswith("file:"):
        log = None
    writer = (markdown_stream(session, directory, max_files_per_trigger, log).writeStream
              .foreachBatch(write_batch).option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now \
        else writer.trigger(processingTime="10 seconds")
    return writer.start()
