"""Length buckets of least padding, and batches under a token budget.

Documents are grouped into ``buckets`` length classes; each is padded to the
upper boundary of its class. Boundaries are chosen by dynamic programming over
the histogram of all lengths, so that the padding summed over all documents is
the least possible. Where a class starts moves up with where it ends, so each
step halves the ranges left to search. Inside a bucket documents are dealt
into batches of as many rows as the token budget holds at the padded length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.ranking import gapless
from quire.session import materialize

BUCKETS = 16
BATCH_TOKENS = 65_536


def token_length(text: Column) -> Column:
    """Words and single signs of a text; null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")),
                      F.lit(0)).cast("long")


def _least_starts(cost: np.ndarray, edges: np.ndarray, rows: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
    """For every end ``j`` the least of ``cost[i] + edges[j - 1] * (rows[j] -
    rows[i])`` over the starts ``i < j``, and the first such start. Least
    starts do not fall with ``j``: the middles of all ranges are searched
    together, between the starts found for the ends around them."""
    n = len(edges)
    least, start = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    lo, hi = np.array([1]), np.array([n])            # ends still open
    first, last = np.array([0]), np.array([n - 1])   # starts possible for them
    while len(lo):
        mid = (lo + hi) // 2
        upto = np.minimum(last, mid - 1)
        size = upto - first + 1
        begin = np.cumsum(size) - size
        i = np.arange(size.sum()) - np.repeat(begin - first, size)
        j = np.repeat(mid, size)
        total = cost[i] + edges[j - 1] * (rows[j] - rows[i])
        least[mid] = np.minimum.reduceat(total, begin)
        hit = np.flatnonzero(total == np.repeat(least[mid], size))
        start[mid] = i[hit[np.searchsorted(hit, begin)]]
        left, right = lo < mid, mid < hi
        lo, hi, first, last = (np.concatenate(x) for x in (
            (lo[left], mid[right] + 1), (mid[left] - 1, hi[right]),
            (first[left], start[mid][right]), (start[mid][left], last[right])))
    return least, start


def boundaries(edges: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper boundaries (some of ``edges``, ascending, last one included) of
    at most ``buckets`` classes with the least total padding.

    ``edges`` are the lengths that occur, ascending; ``counts`` the documents
    of each. Work grows with the distinct lengths times their logarithm.
    """
    n = len(edges)
    if not n:
        return []
    edges = np.asarray(edges, np.int64)
    rows = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    # cost[j]: least padded tokens of lengths 0..j-1; choice[k][j]: start of
    # the last class when k + 1 classes end before length j.
    cost = np.concatenate([[0], edges * rows[1:]])
    choice = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        cost, start = _least_starts(cost, edges, rows)
        choice.append(start)
    out, j = [], n
    for start in reversed(choice):
        if j == 0:
            break
        out.append(int(edges[j - 1]))
        j = int(start[j])
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
         batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Per input row: ``id_col``, ``n_tokens``, ``bucket``, ``padded``,
    ``batch``, ``slot`` and ``padding``.

    ``padded`` is the boundary of the row's bucket, ``batch`` counts from 0
    inside a bucket, ``slot`` from 0 inside a batch. A document longer than
    the budget is a batch of its own. Null and empty texts have length 0 and
    go to the first bucket; null ids and repeated rows each take a slot;
    other columns are ignored; an empty table gives an empty result.
    """
    sized = materialize(docs.select(
        F.col(id_col), token_length(F.col(text)).alias("n_tokens"),
        F.monotonically_increasing_id().alias("_row")), "lengths")
    sized = sized.withColumn("_bin", F.greatest(F.col("n_tokens"), F.lit(1)))
    # One row for each distinct length: their number is at most the square
    # root of twice the tokens of the corpus.
    bins = sized.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("_bin")
    ends = boundaries(bins["_bin"].to_numpy(np.int64), bins["n"].to_numpy(np.int64), buckets)
    bucket, padded = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, end in reversed(list(enumerate(ends))):
        inside = F.col("_bin") <= end
        bucket = F.when(inside, i).otherwise(bucket)
        padded = F.when(inside, F.lit(end).cast("long")).otherwise(padded)
    dealt = gapless(sized.select(id_col, "n_tokens", "_row", bucket.alias("bucket"),
                                 padded.alias("padded")), "bucket", [F.col(id_col)], "_at",
                    row="_row")
    rows = F.greatest(F.floor(F.lit(batch_tokens) / F.col("padded")), F.lit(1)).cast("long")
    return dealt.select(id_col, "n_tokens", "bucket", "padded",
                        F.floor(F.col("_at") / rows).cast("long").alias("batch"),
                        (F.col("_at") % rows).cast("int").alias("slot"),
                        (F.col("padded") - F.col("n_tokens")).alias("padding"))
