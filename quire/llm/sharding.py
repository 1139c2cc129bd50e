"""Shards of nearly equal bytes by a k-d tree over document metadata.

A node that is to become ``k`` shards is split in two so that the left part
holds ``floor(k / 2) / k`` of its bytes, along the metadata dimension that is
widest there (range of values against the range over all rows). The cut is a
distributed weighted median: rows are ordered by the dimension, then by a hash
of the id, and the place where the running bytes reach the target is narrowed
down by histograms of a fixed number of bins, for all nodes of a level at
once. Rows are never sorted or gathered for it; the driver sees histograms and
the tree, both bounded by the number of shards. Everything is built from
DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.ranking import gapless
from quire.session import materialize

BINS = 1024           # bins of one histogram; one per node, and a few levels deep
CLOSE = 0.001         # a cut this near its target, as a share of a shard, is taken
OVERHEAD = 16         # bytes a row counts beside its text
# Keys are kept within 62 bits, so that differences of keys fit in 64.
_LEAST, _MOST = -(1 << 61), (1 << 61) - 1


@dataclass
class Node:
    """A subtree: ``k`` shards from number ``first`` on. Its cut sends rows
    whose key (dimension, hash, row number) is below it to the left part,
    the ``k // 2`` shards from ``first`` on."""

    k: int
    first: int
    dim: int = 0
    cut: tuple[int, int, int] = (0, 0, 0)

    def halves(self) -> list[Node]:
        half = self.k // 2
        return [Node(half, self.first), Node(self.k - half, self.first + half)]


@dataclass
class _Search:
    """Narrowing of one node's cut: the key columns before the current one
    are fixed, the current one lies in ``low..high``; ``before`` bytes are
    known to lie below all of it."""

    node: Node
    target: float
    close: float
    low: int
    high: int
    fixed: tuple[int, ...] = ()
    before: float = 0.0
    done: bool = False

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))

    def row(self) -> tuple:
        return (self.node.first, self.node.dim, len(self.fixed), *(*self.fixed, 0, 0)[:2],
                self.low, self.high, self.width)

    def take(self, bins: list[tuple[int, float]]) -> None:
        """Narrow down with the bytes of each bin, in order."""
        for i, (b, size) in enumerate(bins):
            lo = self.low + b * self.width
            hi = min(lo + self.width - 1, self.high)
            if self.before + size <= self.target and i + 1 < len(bins):
                self.before += size
                continue
            under, over = self.target - self.before, self.before + size - self.target
            if under > self.close and over > self.close:
                if lo < hi:
                    self.low, self.high = lo, hi
                    return
                if len(self.fixed) < 2:
                    # All of the bin shares one value: go on with the next column.
                    self.fixed += (lo,)
                    self.low, self.high = _LEAST, _MOST
                    return
            # Cut at the nearer border of the bin.
            self.low = lo if under <= over else hi + 1
            break
        self.node.cut = (*self.fixed, self.low, _LEAST, _LEAST)[:3]
        self.done = True


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A few rows of whole numbers, as data of the plan: the generated code
    stays the same from level to level."""
    values = ", ".join(f"({', '.join(f'{x}L' for x in row)})" for row in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({names})"))


def _descend(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """Rows with ``_node`` moved from the nodes cut to their halves."""
    cuts = _table(rows.sparkSession, [(n.first, n.dim, *n.cut, n.first + n.k // 2)
                                      for n in nodes], "_n, _dim, _c0, _c1, _c2, _right")
    value = F.get("_dims", F.col("_dim").cast("int"))
    right = (value > F.col("_c0")) | ((value == F.col("_c0")) & (
        (F.col("_hash") > F.col("_c1")) | ((F.col("_hash") == F.col("_c1"))
                                           & (F.col("_row") >= F.col("_c2")))))
    return rows.join(cuts, F.col("_node") == F.col("_n"), "left").withColumn(
        "_node", F.when(right, F.col("_right")).otherwise(F.col("_node"))) \
        .drop("_n", "_dim", "_c0", "_c1", "_c2", "_right")


def _count(rows: DataFrame, searches: list[_Search]) -> dict[int, list[tuple[int, float]]]:
    """Bytes in each bin of each search."""
    open_ = _table(rows.sparkSession, [s.row() for s in searches],
                   "_n, _dim, _depth, _f0, _f1, _low, _high, _width")
    value, depth = F.get("_dims", F.col("_dim").cast("int")), F.col("_depth")
    key = F.when(depth == 0, value).when(depth == 1, F.col("_hash")).otherwise(F.col("_row"))
    inside = (key.between(F.col("_low"), F.col("_high"))
              & ((depth < 1) | (value == F.col("_f0")))
              & ((depth < 2) | (F.col("_hash") == F.col("_f1"))))
    found = rows.join(open_, F.col("_node") == F.col("_n")).filter(inside) \
        .withColumn("_key", key).withColumn("_bin", F.expr("(_key - _low) div _width")) \
        .groupBy("_n", "_bin").agg(F.sum("size").alias("bytes")).collect()
    out: dict[int, list[tuple[int, float]]] = {}
    for r in sorted(found):
        out.setdefault(r[0], []).append((r[1], float(r[2])))
    return out


def _grow(rows: DataFrame, dims: int, shards: int) -> DataFrame:
    """``rows`` with the number of their leaf as ``_node``."""
    ends = [f(F.get("_dims", F.lit(i))) for i in range(dims) for f in (F.min, F.max)]

    def ranges(frame: DataFrame) -> dict:
        return {r[0]: (r[1], [(r[2 + 2 * i], r[3 + 2 * i]) for i in range(dims)])
                for r in frame.groupBy("_node").agg(F.sum("size"), *ends).collect()}
    placed, growing = rows, [Node(shards, 0)]
    whole = None
    while growing := [n for n in growing if n.k > 1]:
        stats = ranges(placed)
        whole = whole or stats.get(0)
        if whole is None:
            return placed
        close = CLOSE * whole[0] / shards
        wide = [max(hi - lo, 1) for lo, hi in whole[1]]
        searches = []
        for node in growing:
            if node.first in stats:
                size, spans = stats[node.first]
                node.dim = max(range(dims), key=lambda i, spans=spans: (
                    spans[i][1] - spans[i][0]) / wide[i])
                searches.append(_Search(node, size * (node.k // 2) / node.k, close,
                                        *spans[node.dim]))
        while open_ := [s for s in searches if not s.done]:
            counted = _count(placed, open_)
            for search in open_:
                search.take(counted.get(search.node.first, []))
        # Written level by level: the plans keep one shape.
        placed = materialize(_descend(placed, growing), "shard-nodes")
        growing = [half for n in growing for half in n.halves()]
    return placed


def kd_shards(docs: DataFrame, dims: dict[str, Column], shards: int | None = None,
              target_bytes: int | None = None, id_col: str = "doc_id",
              text: str = "text") -> DataFrame:
    """Per input row: ``id_col``, ``size`` (UTF-8 bytes of the text plus 16),
    ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in a shard).

    ``dims`` names the metadata dimensions and gives each as a whole number
    (null counts as 0). State either the number of ``shards`` or the
    ``target_bytes`` of one. Shards differ in bytes by little more than one
    row for each split above them. Null and empty texts have 16 bytes; null
    ids are one more id; rows that repeat an id, even whole, are told apart by
    a row number, so any group can be split; other columns are ignored; an
    empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # Written once: the row numbers must not change between passes.
    rows = materialize(docs.select(
        F.col(id_col), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.array(*[F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), F.coalesce(
            c.cast("long"), F.lit(0).cast("long")))) for c in dims.values()]).alias("_dims"),
        F.shiftright(F.xxhash64(F.col(id_col)), 2).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"), F.lit(0).cast("long").alias("_node")),
        "shard-rows")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, round(total / target_bytes))
    placed = _grow(rows, len(dims), shards).withColumn("shard", F.col("_node").cast("int"))
    return gapless(placed, "shard", [F.col(id_col), F.col("_row")]) \
        .select(id_col, "size", "text_crc32", "shard", "slot")
