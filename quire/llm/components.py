"""Connected components of an edge table, by alternating star contraction.

Every round rewrites the edges so that nodes point at smaller neighbours
(large star over all neighbours, small star over smaller ones) until only
stars are left. A node's neighbours are reduced with a partial ``min`` and
joined back, so no neighbourhood is gathered in one task. Every round is
written to the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u") \
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"),
                                                          F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)),
                           F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (u, v)``, where
    ``component`` is the smallest node of its component.

    Self loops, repeated edges and either direction are allowed; rows with a
    null end are no edges; an empty table gives an empty result.
    """
    work = materialize(edges.select("u", "v").filter("u <> v")
                       .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                       .distinct(), "edges")
    seen = _state(work)
    while seen[0]:
        work = materialize(_small_star(_large_star(work)), "edges")
        now = _state(work)
        if now == seen:
            break
        seen = now
    return work.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(work.select("v", "v")).distinct()
