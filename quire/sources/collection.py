"""Named chunk collections as parquet tables (A3-A5, B1-B3).

A collection ``name`` under ``root`` is the parquet table ``<root>/<name>``
with the chunk schema. Writers append; ids are unique (first writer wins, as
the vector store ignores an id it already holds). Single writer per
collection: appends are not atomic across concurrent writers.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import empty_frame

CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("document", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("source_file", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("total_chunks", T.IntegerType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

# What is stored: the filter fields are columns of their own, so that filters
# on them reach the scan.
STORED_SCHEMA = T.StructType(CHUNK_SCHEMA.fields + [
    T.StructField("type", T.StringType()), T.StructField("author", T.StringType())])

# New ids of up to this many bytes are broadcast to probe the existing table;
# larger sets use a shuffle join that AQE may re-plan.
BROADCAST_ID_BYTES = 64 << 20
_ID_ROW = 48  # bytes of a row beside its id


def collection_path(root: str, name: str) -> str:
    return os.path.join(root, name)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def read_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The collection's chunks; a missing collection reads as empty (A3),
    as the reference's reader returns no results instead of failing."""
    path = collection_path(root, name)
    if not _exists(spark, path):
        return empty_frame(spark, STORED_SCHEMA)
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def create_collection(spark: SparkSession, root: str, name: str) -> str:
    """Get-or-create (B2): an empty table exists even when nothing was added."""
    path = collection_path(root, name)
    if not _exists(spark, path):
        empty_frame(spark, STORED_SCHEMA).write.mode("append").parquet(path)
    return path


def get(coll: DataFrame, include: list[str] | None = None) -> DataFrame:
    """Full scan with field selection (A4); ``id`` is always returned."""
    cols = ["id"] + [c for c in (include or []) if c != "id"]
    if include and "metadatas" in include:
        cols = ["id", "metadata", "source_file", "chunk_index", "total_chunks"] + \
            [c for c in include if c not in ("id", "metadatas")]
    return coll.select(*dict.fromkeys(cols))


def count(coll: DataFrame) -> DataFrame:
    """Row count as a one-row DataFrame (A5)."""
    return coll.agg(F.count(F.lit(1)).alias("count"))


def _repeated(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("id").agg(F.count(F.lit(1)).alias("_n")) \
        .filter(F.col("_n") > 1).select("id")


def first_writer(chunks: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """One row per id: the row from the file that sorts first (the reference
    processes files in sorted path order and the first add wins).

    Only ids are shuffled to find repeats (an aggregate with partial counts);
    rows of unique ids pass through untouched, and only rows of repeated ids
    go through a ``min_by`` aggregate (partial per task, so an id shared by a
    huge number of files never lands whole in one task). Joins against the
    repeated-id set are left to the optimizer, which broadcasts it at run time
    when it is small. Feed it a materialised table: the input is read three
    times. ``repeated``: the ids that occur more than once, where known.
    """
    order_key = F.split(F.col("source_file"), "/")  # Path order: by components
    cols = [c for c in chunks.columns if c != "id"]
    repeated = _repeated(chunks) if repeated is None else repeated
    unique_rows = chunks.join(repeated, "id", "left_anti")
    packed = chunks.join(repeated, "id", "left_semi") \
        .select("id", F.struct(*cols).alias("_r"), order_key.alias("_k"))
    best = packed.groupBy("id").agg(F.min_by("_r", "_k").alias("_r"))
    winners = best.select("id", *[F.col(f"_r.{c}").alias(c) for c in cols])
    return unique_rows.select("id", *cols).unionByName(winners)


def _known(ids: DataFrame, label: str, broadcast_limit: int) -> tuple[DataFrame, int]:
    """``ids`` written down, with a broadcast hint where they are few bytes, and
    their number."""
    from quire.session import materialize  # noqa: PLC0415

    ids = materialize(ids, label)
    n, size = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("id")), F.lit(0))).first()
    return (ids.hint("broadcast") if size + _ID_ROW * n <= broadcast_limit else ids), n


def add_chunks(spark: SparkSession, new: DataFrame, root: str, name: str,
               broadcast_limit: int = BROADCAST_ID_BYTES) -> dict:
    """Append chunks whose id is not in the collection yet (B1).

    The produced chunks are written once to the shared checkpoint folder, so
    counting and writing do not recompute tokenizing and embedding, and a
    lost executor re-reads the checkpoint instead of the whole lineage.
    ``broadcast_limit`` bounds the bytes of the new ids that are broadcast.
    Collisions are found by probing the existing id column with the (size
    checked) set of new ids, so the existing table is scanned once and never
    shuffled. Returns the number of produced chunks.
    """
    from quire.session import materialize  # noqa: PLC0415

    path = create_collection(spark, root, name)
    produced = materialize(new.select(*CHUNK_SCHEMA.fieldNames()), "produced")
    n_produced, id_bytes = produced.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("id")), F.lit(0))).first()
    # Ids already stored: probe the existing id column with the produced ids
    # (a superset of the fresh ones, measured above), so the existing table
    # is scanned once and never shuffled.
    existing_ids = spark.read.schema(CHUNK_SCHEMA).parquet(path).select("id")
    probe = produced.select("id")
    if id_bytes + _ID_ROW * n_produced <= broadcast_limit:
        probe = F.broadcast(probe)
    # Both sets of ids are written before they are joined: only then is it
    # known whether they are small (mostly they are empty), and a join that is
    # planned without knowing it shuffles every chunk first.
    insert = produced
    repeated, some = _known(_repeated(produced), "repeated-ids", broadcast_limit)
    if some:
        insert = first_writer(produced, repeated)
    taken, some = _known(existing_ids.join(probe, "id", "left_semi"), "taken-ids", broadcast_limit)
    if some:
        insert = insert.join(taken, "id", "left_anti")
    insert = insert.select(*CHUNK_SCHEMA.fieldNames(), F.col("metadata")["type"].alias("type"),
                           F.col("metadata")["author"].alias("author"))
    # Files hold disjoint, sorted id ranges: row-group statistics on id then
    # let retrieval read only the row groups of the chunks it returns.
    insert.repartitionByRange("id").sortWithinPartitions("id") \
        .write.mode("append").parquet(path)
    return {"chunks_produced": n_produced}


def ingest_stats(files: DataFrame | int, chunks: DataFrame,
                 collection_name: str | None = None) -> DataFrame:
    """One row: ``files_processed`` (every file found, empty ones included),
    ``chunks_added`` (chunks produced, whether or not newly inserted),
    ``collection_name`` (NULL when no files were found, as the reference
    then reports only the two zeros) (B3)."""
    n_files = files if isinstance(files, int) else files.count()
    agg = chunks.agg(F.count(F.lit(1)).alias("chunks_added"))
    return agg.select(
        F.lit(n_files).cast("long").alias("files_processed"),
        F.when(F.lit(n_files) > 0, F.col("chunks_added")).otherwise(F.lit(0))
        .cast("long").alias("chunks_added"),
        (F.lit(collection_name) if n_files > 0 else F.lit(None)).cast("string")
        .alias("collection_name"),
    )
