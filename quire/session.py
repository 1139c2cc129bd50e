"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library assumes. AQE re-plans joins and coalesces small shuffle
# partitions at runtime; the runtime bloom filter lets a small result side prune
# the big chunk table before a shuffle join.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Split a file so that at least every core reads a part of it.
    "spark.sql.files.openCostInBytes": "1048576",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "quire",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` is only applied when given; on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is read, never
    overridden. Only when it is unset on a local master (tests) do we pick our
    own folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at shared storage")
        configured = tempfile.mkdtemp(prefix="quire-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df, label: str = "table", file_rows: int = 0):
    """Cut lineage by writing ``df`` as a parquet table under the shared
    ``spark.checkpoint.dir`` and reading it back.

    Columnar and compressed (zstd: about two thirds of the default codec's
    bytes), so later scans read only the columns they use;
    a lost executor re-reads the table instead of recomputing the lineage.
    ``file_rows`` bounds the rows of a file, so that later scans can share out
    what one task wrote.
    """
    spark = df.sparkSession
    path = table_folder(spark, label)
    df.write.mode("errorifexists").option("compression", "zstd") \
        .option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.parquet(path)


_FOLDERS: list[str] = []  # of this process, dropped when it ends


def table_folder(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables under the shared checkpoint
    folder. It is dropped by :func:`drop_tables`, at the latest when the
    driver ends normally."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/quire-tables/{label}-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(drop_tables, spark)
    _FOLDERS.append(path)
    return path


def drop_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; their number. Frames
    that still read them can no longer be computed."""
    jvm, dropped = spark.sparkContext._jvm, 0
    conf = jvm.org.apache.hadoop.conf.Configuration()
    while _FOLDERS:
        folder = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        dropped += bool(folder.getFileSystem(conf).delete(folder, True))
    return dropped


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def empty_frame(spark: SparkSession, schema):
    """An empty DataFrame with ``schema``, built on the JVM (an empty Python
    list would be shipped through Python workers, one per default task)."""
    from pyspark.sql import functions as F  # noqa: PLC0415

    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name)
                                   for f in schema.fields])
