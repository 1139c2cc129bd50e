"""Embedding (C10): one vector per text, same model for chunks and questions.

The reference delegates to a sentence-embedding model that is not available
offline, so the default here is a deterministic hashed bag of words:

* words: ``[\\p{L}\\p{M}\\p{N}]+`` runs of the lower-cased text (Spark regex,
  on the JVM);
* bucket of a word: first 8 hex digits of its MD5, as an integer, modulo
  ``dims``;
* vector: bucket counts scaled to unit L2 norm, stored as ``array<float>``
  (all zeros for a text without words).

Words are split by Spark; hashing them into buckets and counting bucket ids
into vectors is done in an Arrow UDF, for a batch at a time: there is no
built-in that counts array elements per value without an O(words x dims)
lambda.

Any other model plugs in through :func:`embed_with`: a function from a pandas
Series of texts to a list of vectors, run with ``mapInPandas`` and loaded once
per task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import WORD

DEFAULT_DIMS = 256


def words(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def buckets(col: Column | str, dims: int = DEFAULT_DIMS) -> Column:
    """``array<int>``: bucket of every word, ``int(md5(word)[:8], 16) % dims``,
    as a Spark expression (for inspection and SQL parity checks)."""
    return F.transform(
        words(col),
        lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"),
                         F.lit(dims)).cast("int"))


def _hashed_vectors(dims: int):
    def embed_words(rows: pa.Array) -> pa.Array:
        """One vector per list of words. Every distinct word of the batch is
        hashed once, and all rows are counted together."""
        import hashlib  # noqa: PLC0415 - executor side

        n = len(rows)
        flat = rows.flatten().dictionary_encode()
        bucket = np.array([int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16) % dims
                           for w in flat.dictionary.to_pylist()], np.int64)
        lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cell = np.repeat(np.arange(n), lengths) * dims
        if len(flat):
            cell += bucket[flat.indices.to_numpy()]
        counts = np.bincount(cell, minlength=n * dims).reshape(n, dims).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1))
        norm[norm == 0] = 1.0
        vectors = (counts / norm[:, None]).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dims,
                                        pa.array(vectors.ravel()))

    return embed_words


def hashed_embedding(col: Column | str, dims: int = DEFAULT_DIMS) -> Column:
    """``array<float>`` hashed bag-of-words vector of a text column.

    Words are split by Spark; an Arrow UDF encodes the words of a batch as a
    dictionary, hashes the dictionary and counts all rows with one
    ``np.bincount``.
    """
    udf = F.arrow_udf(_hashed_vectors(dims), T.ArrayType(T.FloatType()))
    return udf(words(col))


def embed(df: DataFrame, text_col: str, out_col: str = "embedding",
          dims: int = DEFAULT_DIMS) -> DataFrame:
    """Add ``out_col`` with the default (hashed) embedding of ``text_col``."""
    return df.withColumn(out_col, hashed_embedding(text_col, dims))


def embed_with(df: DataFrame, text_col: str, model_factory: Callable[[], Callable],
               out_col: str = "embedding") -> DataFrame:
    """Embed with any model: ``model_factory()`` runs once per task and returns
    ``f(pandas.Series[str]) -> sequence of float vectors``."""
    schema = T.StructType(df.schema.fields + [
        T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches):
        model = model_factory()
        for pdf in batches:
            vecs = model(pdf[text_col])
            pdf[out_col] = [np.asarray(v, dtype=np.float32) for v in vecs]
            yield pdf

    return df.mapInPandas(run, schema)
