"""Corpus sync (F1): which candidate articles are not in the corpus yet.

The reference names an RSS sync that pulls "new articles"; its source is not
in the snapshot, so only the set logic is rebuilt: candidates keyed by URL,
minus the keys already known, one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_articles(candidates: DataFrame, known: DataFrame, key: str = "url",
                 order: str | None = None) -> DataFrame:
    """Candidates whose ``key`` is absent from ``known``; one row per key (the
    smallest ``order`` value wins, so the result is deterministic).

    The per-key pick is an aggregate with partial aggregation, so a key
    repeated in many candidates is reduced before its shuffle. The optimizer
    may move the anti join below the aggregate; with a small known set it is
    a broadcast hash join, so candidates are never shuffled for it.
    """
    cols = [c for c in candidates.columns if c != key]
    if cols:
        packed = F.struct(*cols)
        pick = F.min_by(packed, F.col(order)) if order else F.min(packed)
        # One row per key first (partial aggregation before the shuffle), so
        # a key repeated across many candidates reaches the join once.
        one = candidates.groupBy(key).agg(pick.alias("_r")).select(
            key, *[F.col(f"_r.{c}").alias(c) for c in cols])
    else:
        one = candidates.select(key).distinct()
    return one.join(known.select(key).distinct(), key, "left_anti")
