"""Corpus ingest as one Spark job: directory -> collection (the reference's
``ingest_directory``).

scan -> frontmatter split -> metadata map -> token windows -> ids ->
embedding -> first-writer dedup -> anti-join append. Every step up to the
dedup is narrow (no shuffle); the dedup is an aggregate with partial
aggregation; the append probes the existing ids with the new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.chunking import (MAX_TOKENS, STRIDE, chunk_by_tokens,
                                      with_chunk_identity)
from quire.operators.embed import DEFAULT_DIMS, embed
from quire.operators.frontmatter import frontmatter_map, split_frontmatter
from quire.sources.collection import add_chunks, create_collection
from quire.sources.markdown import count_markdown_files, scan_markdown


def articles_to_chunks(articles: DataFrame, *, no_chunk: bool = False,
                       max_tokens: int = MAX_TOKENS, stride: int = STRIDE,
                       frontmatter_mode: str = "flat", dims: int = DEFAULT_DIMS,
                       with_embedding: bool = True) -> DataFrame:
    """``source_file, text`` rows -> chunk rows in the collection schema."""
    parsed = frontmatter_map(split_frontmatter(articles, "text"), "fm", mode=frontmatter_mode)
    parsed = parsed.select("source_file", "metadata", "content")
    chunks = chunk_by_tokens(parsed, "content", max_tokens, stride,
                             tokenizer=None if no_chunk else "pieces")
    chunks = with_chunk_identity(chunks)
    if no_chunk:
        # The reference still counts tokens of the single chunk.
        from quire.functions.text import token_count  # noqa: PLC0415
        chunks = chunks.withColumn("token_count", token_count("document").cast("int"))
    if with_embedding:
        chunks = embed(chunks, "document", "embedding", dims)
    else:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    return chunks.select("id", "document", "embedding", "source_file", "chunk_index",
                         "total_chunks", "token_count", "metadata")


def ingest_directory(spark: SparkSession, directory: str, root: str,
                     collection_name: str = "blog_posts", *, no_chunk: bool = False,
                     frontmatter_mode: str = "flat", dims: int = DEFAULT_DIMS) -> dict:
    """Ingest every ``*.md`` under ``directory`` into ``root/collection_name``.

    Returns the reference's statistics dict. Raises ``FileNotFoundError`` for
    a missing directory; creates the (empty) collection even without files.
    """
    n_files = count_markdown_files(spark, directory)
    create_collection(spark, root, collection_name)
    if n_files == 0:
        return {"files_processed": 0, "chunks_added": 0}
    chunks = articles_to_chunks(scan_markdown(spark, directory), no_chunk=no_chunk,
                                frontmatter_mode=frontmatter_mode, dims=dims)
    res = add_chunks(spark, chunks, root, collection_name)
    return {"files_processed": n_files, "chunks_added": int(res["chunks_produced"]),
            "collection_name": collection_name}
