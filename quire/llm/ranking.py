"""Gapless positions inside groups of any size.

A plain ``row_number`` over a group sorts the whole group in one task. Here
every group is cut into hash blocks; each block is numbered on its own and a
small table of block totals gives the offset of every block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

# Hash blocks per group. The table of block totals has at most
# ``groups * BLOCKS`` rows, whatever the number of rows ranked.
BLOCKS = 256


def gapless(df: DataFrame, group: str, order: list[Column], out: str = "slot",
            blocks: int = BLOCKS, row: str | None = None) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... inside each value of ``group``.

    ``group`` must take a bounded number of values (shards, buckets): the
    block totals are broadcast. Rows are ordered by a hash of ``order`` and
    then by ``order`` itself. A null ``order`` value is one more value; rows
    equal in all of ``order`` get distinct positions in no fixed order. With
    ``row``, a column of row numbers, such rows are dealt over all blocks, so
    one value that many rows share fills no block alone.
    """
    if row is None:
        cut = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    else:
        order = [*order, F.col(row)]
        keyed = df.withColumn("_key", F.xxhash64(*order[:-1]))
        # Written, so that its true size decides how it is joined.
        shared = materialize(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_m"))
                             .filter("_m > 1").select("_key", F.lit(True).alias("_many")), "shared")
        cut = keyed.join(shared, "_key", "left").withColumn("_block", F.pmod(
            F.when(F.col("_many"), F.xxhash64(*order)).otherwise(F.col("_key")),
            F.lit(blocks)).cast("int")).drop("_key", "_many")
    totals = cut.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("_g"), F.col("_block").alias("_b"),
                            F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    numbered = cut.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), F.col(group).eqNullSafe(F.col("_g"))
                         & (F.col("_block") == F.col("_b"))) \
        .withColumn(out, (F.col("_before") + F.col("_i")).cast("long")) \
        .drop("_block", "_g", "_b", "_before", "_i")
