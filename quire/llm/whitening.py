"""Whitening of embeddings with distributed block matrices (Spark MLlib).

Entries become whole numbers first, so sums over the corpus are exact. The
centred rows are an ``IndexedRowMatrix`` cut into blocks; the transposed block
matrix times itself is the scatter matrix, whose eigenvectors are found
locally (its size is that of the dimensions, not of the corpus). A second
product, with the whitening matrix, projects all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import empty_frame, materialize

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000  # entry c becomes floor(SCALE * c) + OFFSET
LARGEST = 2.0 ** 40            # entries beyond count as non-finite
BLOCK_CELLS = 1 << 16          # numbers in a block of rows
BLOCKS_TOGETHER = 16           # row blocks that one task multiplies and adds up
# Eigenvalues below this part of the largest are rounding: no variance.
NO_VARIANCE = 1e-13


def _usable(vector: Column) -> Column:
    """Whether a vector holds numbers only."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def whole_rows(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id``, ``index`` (0, 1, ... without gaps) and ``x``, the vector as
    whole numbers, of the rows that remain. It is a written table."""
    x = F.transform(F.col(vector).cast("array<double>"),
                    lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long"))
    doubles = F.col(vector).cast("array<double>")
    kept = materialize(rows.filter(_usable(doubles)).select(
        F.col(id_col).alias("id"), x.alias("x"), F.monotonically_increasing_id().alias("row")),
        "vectors")
    widths = kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = widths.orderBy(F.desc("n"), "d").first()
    if most is None:
        return kept.select("id", F.col("row").alias("index"), "x")
    kept = kept.filter(F.size("x") == most["d"])
    # Numbered without gaps: by place inside a partition of the table and the
    # rows of the partitions before it (a row for each partition).
    place = F.row_number().over(Window.partitionBy("_p").orderBy("row"))
    parts = kept.groupBy(F.shiftright("row", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = parts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = kept.withColumn("_p", F.shiftright("row", 33)).withColumn("_at", place - 1)
    return materialize(numbered.join(before, "_p").select(
        "id", (F.col("_before") + F.col("_at")).cast("long").alias("index"), "x"), "vectors")


def column_sums(vectors: DataFrame) -> list[int]:
    """Exact sum of every dimension."""
    per = vectors.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s"))
    return [int(r["s"]) for r in per.orderBy("at").collect()]  # a row for each dimension


def block_matrix(frame: DataFrame, n: int, width: int) -> BlockMatrix:
    """Block matrix of ``index, vector`` (an array column), all on the JVM."""
    rows = MLUtils.convertVectorColumnsFromML(
        frame.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(rows, n, width).toBlockMatrix(max(1, BLOCK_CELLS // width), width)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transposed matrix times matrix, as a local matrix of the dimensions.

    The inner dimension is split, so that row blocks are multiplied and added
    up in many tasks: the method's split argument is called on the JVM matrix,
    which the Python class does not pass on.
    """
    blocks = -(-matrix.numRows() // matrix.rowsPerBlock)
    splits = max(1, -(-blocks // BLOCKS_TOGETHER))
    product = matrix.transpose()._java_matrix_wrapper.call(
        "multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def principal_axes(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as
    columns, with the entry of largest size positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])


def project(spark: SparkSession, matrix: BlockMatrix, axes: np.ndarray) -> DataFrame:
    """``index, p``: every row of ``matrix`` times ``axes``."""
    local = Matrices.dense(axes.shape[0], axes.shape[1], axes.ravel(order="F").tolist())
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1),
                        axes.shape[0], axes.shape[1])
    rows = matrix.multiply(right).toIndexedRowMatrix()
    # A data frame of the indexed rows, which stays on the JVM.
    frame = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return frame.select("index", vector_to_array("vector").alias("p"))


def _identity_error(projected: DataFrame, n: int, used: list[int]) -> float | None:
    """Largest distance of the projection's covariance from the identity."""
    if not used:
        return None
    means = projected.agg(*[F.avg(F.col("p")[i]).alias(f"m{i}") for i in used]).first()
    centred = {i: F.col("p")[i] - F.lit(means[f"m{i}"]) for i in used}
    pairs = [(i, j) for i in used for j in used if i <= j]
    sums = projected.agg(*[F.sum(centred[i] * centred[j]).alias(f"s{i}_{j}")
                           for i, j in pairs]).first()
    return max(abs(sums[f"s{i}_{j}"] / n - (i == j)) for i, j in pairs)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: ``id_col``, ``component``
    (from 1, by falling variance), ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``.

    Vectors that are null or empty, hold a null or non-finite entry or one
    beyond 2 ** 40, or are of another width than most (of equally many, the
    smaller width) are left out. ``components`` are at most the dimensions. A
    component without variance has a null ``whitened`` and does not count for
    ``identity_error``; a ``deviation`` no 64-bit number holds is null. Null
    and repeated ids and repeated rows stay; other columns are ignored; a
    table without usable vectors gives an empty result.
    """
    spark = rows.sparkSession
    vectors = whole_rows(rows, id_col, vector)
    n = vectors.count()
    if not n:
        schema = spark.createDataFrame([], "component int, n long, deviation long, "
                                       "whitened double, explained double, identity_error double")
        return vectors.limit(0).select(F.col("id").alias(id_col)).join(
            empty_frame(spark, schema.schema), F.lit(True))
    sums = column_sums(vectors)
    width = len(sums)
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = F.zip_with("x", mean, lambda x, m: x.cast("double") - m)
    matrix = block_matrix(vectors.select("index", centred.alias("vector")), n, width)
    covariance = scatter(matrix) / n
    values, axes = principal_axes(covariance, min(components, width))
    trace = float(np.trace(covariance))
    used = [i for i, e in enumerate(values) if e > NO_VARIANCE * max(values[0], 0.0)]
    scales = np.array([1 / np.sqrt(e) if i in used else 0.0 for i, e in enumerate(values)])
    projected = materialize(project(spark, matrix, axes * scales), "whitened")
    error = _identity_error(projected, n, used)

    parts = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]),
                       lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(n).cast("long")), s))
    deviation = F.aggregate(parts, F.lit(0).cast("long"),
                            lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    facts = [F.struct(F.lit(i + 1).alias("component"),
                      (F.col("p")[i] if i in used else F.lit(None).cast("double"))
                      .alias("whitened"),
                      F.lit(float(e / trace) if trace > 0 else None).cast("double")
                      .alias("explained")) for i, e in enumerate(values)]
    return vectors.select("id", "index", deviation.alias("deviation")).join(projected, "index") \
        .select(F.col("id").alias(id_col), "deviation", F.explode(F.array(*facts)).alias("f")) \
        .select(id_col, "f.component", F.lit(n).cast("long").alias("n"), "deviation",
                "f.whitened", "f.explained",
                F.lit(error).cast("double").alias("identity_error"))
