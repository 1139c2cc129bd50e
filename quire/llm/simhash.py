"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most ``max_bits`` bits must be close in at
least one of several disjoint bit blocks. The first two blocks are 23 bits
wide and tolerate one differing bit; their anchors are the words of the
perfect binary Golay code, whose covering radius is 3: every block value lies
within 3 bits of one anchor (its home) and is replicated to every anchor
within 3 + 1 bits, 1 or 6 of them. The blocks left tolerate no difference, so
each value is its own anchor (a code of covering radius 0). Two close
fingerprints therefore meet at the home anchor of either one, and each anchor
compares its members exactly.

Equal fingerprints are grouped first, so copies never meet in a comparison.
An anchor emits a spanning forest of its links rather than all pairs, which
keeps dense groups linear in size and loses no component. Anchors with very
many members are split by the exact value of ``max_bits + 1`` further blocks,
one of which any close pair shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.session import materialize

SEED = 42
GOLAY_BITS = 23
GOLAY_RADIUS = 3
GOLAY_POLY = 0b101011100011  # generator polynomial of the binary Golay code
# Members of an anchor above which it is split by further exact blocks. It
# bounds the work of one comparison and changes no result.
SPLIT_ABOVE = 20_000
_HASH_BLOCK = 1 << 15


# --- fingerprints ---------------------------------------------------------
def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text, as an unsigned int.

    ASCII letters are lower-cased and words are split at ASCII white space.
    A text shorter than one shingle is one shingle; no words (or null): 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total = max(len(words) - shingle + 1, 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for lo in range(0, total, _HASH_BLOCK):
        hi = min(lo + _HASH_BLOCK, total)
        h = np.fromiter([digest(join(words[i:i + shingle]), SEED) for i in range(lo, hi)],
                        np.dtype("<u8"), hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4,
                     out: str = "fp") -> DataFrame:
    """Add ``out``, the fingerprint as a signed 64-bit integer."""
    @F.pandas_udf("long")
    def fp(texts):
        return texts.map(lambda t: np.uint64(fingerprint(t, shingle)).view(np.int64)) \
            .astype("int64")
    return docs.withColumn(out, fp(F.col(text)))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- covering code --------------------------------------------------------
def _syndrome_of_bits(n: int) -> np.ndarray:
    """Remainder of ``x ** i`` by the generator polynomial, for each bit."""
    out, r = [], 1
    for _ in range(n):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= GOLAY_POLY
    return np.array(out, np.int64)


class GolayAnchors:
    """Anchors within covering radius + 1 of 23-bit values."""

    def __init__(self):
        per_bit = _syndrome_of_bits(GOLAY_BITS)
        halves = []
        for shift, width in ((0, 12), (12, 11)):
            values = np.arange(1 << width)
            table = np.zeros(1 << width, np.int64)
            for b in range(width):
                table ^= np.where(values >> b & 1, per_bit[shift + b], 0)
            halves.append(table)
        self._low, self._high = halves
        # Error patterns of at most radius + 1 bits, by syndrome: adding one
        # to a value of that syndrome gives a code word.
        patterns = [0]
        frontier = [(0, -1)]
        for _ in range(GOLAY_RADIUS + 1):
            frontier = [(p | 1 << b, b) for p, last in frontier
                        for b in range(last + 1, GOLAY_BITS)]
            patterns += [p for p, _ in frontier]
        by = np.array(patterns, np.int64)
        syn = self._syndrome(by)
        order = np.argsort(syn, kind="stable")
        self._patterns, counts = by[order], np.bincount(syn, minlength=2048)
        self._start, self._count = np.cumsum(counts) - counts, counts

    def _syndrome(self, x: np.ndarray) -> np.ndarray:
        return self._low[x & 0xFFF] ^ self._high[x >> 12]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, anchor)`` for every anchor of every value."""
        syn = self._syndrome(x)
        n = self._count[syn]
        row = np.repeat(np.arange(len(x)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, x[row] ^ self._patterns[self._start[syn][row] + nth]


def bit_blocks(max_bits: int) -> list[tuple[int, int, bool]]:
    """``(shift, width, covered)`` blocks of the 64 bits, such that values
    within ``max_bits`` agree in an exact block or differ by at most one bit
    in a covered one: covered blocks count for two, exact ones for one, and
    together they count for ``max_bits + 1``."""
    golay = min(2, (max_bits + 1) // 2)
    exact = max_bits + 1 - 2 * golay
    left = 64 - GOLAY_BITS * golay
    if max_bits < 0 or exact > left:
        raise ValueError(f"max_bits must be from 0 to {left + 2 * golay - 1}")
    blocks = [(GOLAY_BITS * i, GOLAY_BITS, True) for i in range(golay)]
    edges = [64 - left + left * i // max(exact, 1) for i in range(exact + 1)]
    return blocks + [(a, b - a, False) for a, b in zip(edges, edges[1:])]


def _field(fp: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)


def _replicas(max_bits: int):
    blocks = bit_blocks(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = GolayAnchors()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (shift, width, covered) in enumerate(blocks):
                x = _field(fp, shift, width)
                row, anchor = golay(x) if covered else (np.arange(len(x)), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), i, np.int32)), pa.array(anchor),
                     pa.array(fp[row].view(np.int64))], names=["block", "anchor", "fp"])
    return run


# --- comparison at an anchor ----------------------------------------------
def forest(fp: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning-forest edges of the links among distinct fingerprints."""
    t, out = np.uint8(max_bits), []
    if len(fp) <= 512:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= t
        i, j = np.nonzero(np.triu(near, 1))
        if len(i) <= 4 * len(fp):
            return [(fp[i], fp[j])] if len(i) else []
    rest = fp
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            head = queue.pop()
            for x in head:
                near = np.bitwise_count(rest ^ x) <= t
                if near.any():
                    found, rest = rest[near], rest[~near]
                    out.append((np.full(len(found), x, np.uint64), found))
                    queue.append(found)
    return out


def _compare(max_bits: int):
    def links(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for u, v in forest(fp, max_bits):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)),
                                              pa.array(v.view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # members of the group still open
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            fp = cols[3].view(np.uint64)
            keys = np.stack(cols[:3], axis=1).astype(np.int64)
            if not len(fp):
                continue
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(fp)]):
                if key != (now := tuple(keys[lo])):
                    if sum(map(len, held)) > 1:
                        yield from links(np.concatenate(held))
                    key, held = now, []
                held.append(fp[lo:hi])
        if sum(map(len, held)) > 1:
            yield from links(np.concatenate(held))
    return run


def near_links(fps: DataFrame, max_bits: int = 4, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints (column ``fp``) that
    join every pair within ``max_bits`` directly or through other links."""
    members = fps.mapInArrow(_replicas(max_bits), "block int, anchor long, fp long")
    # At most one row for each code word or exact block value.
    large = members.groupBy("block", "anchor").agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") > split_above).select("block", "anchor", F.lit(True).alias("large"))
    k = max_bits + 1
    edges = [64 * i // k for i in range(k + 1)]
    parts = [F.lit(i) * F.lit(1 << 58) + F.shiftrightunsigned("fp", a).bitwiseAND(
        F.lit((1 << min(b - a, 58)) - 1)) for i, (a, b) in enumerate(zip(edges, edges[1:]))] \
        if k <= 31 else [F.lit(0).cast("long")]
    dealt = members.join(F.broadcast(large), ["block", "anchor"], "left") \
        .select("block", "anchor", F.explode(
            F.when(F.col("large"), F.array(*parts))
            .otherwise(F.array(F.lit(-1).cast("long")))).alias("part"), "fp")
    keys = ["block", "anchor", "part"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys) \
        .mapInArrow(_compare(max_bits), "u long, v long")


def _classes(rows: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """``fp, component`` (a fingerprint of it) and ``component_id`` of every
    fingerprint of ``rows (id_col, fp)``. It is a written table, so that its
    true size decides how it is joined."""
    classes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    parts = connected_components(near_links(classes.select("fp"), max_bits))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return materialize(named.join(ids, "component").select("fp", "component", "component_id"),
                       "per-class")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                       shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: ``id_col``, ``fp`` (signed), ``component_id``.

    ``component_id`` is the smallest id reachable over fingerprints that
    differ in at most ``max_bits`` bits, itself included. Null and empty texts
    have fingerprint 0 and are linked like any other; a null id counts for
    its fingerprint but never as a component's id; repeated rows stay; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = materialize(with_fingerprint(docs.select(F.col(id_col), F.col(text).alias("_text")),
                                        "_text", shingle).select(id_col, "fp"), "fingerprints")
    return rows.join(_classes(rows, id_col, max_bits), "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                         shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest id, null
    ids last, and of rows with this id the first by row number. Rows are told
    apart by their numbers alone, so a repeated or null id loses no text of
    another component."""
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    # Written once: the row numbers must not change between passes.
    kept = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    fps = materialize(with_fingerprint(kept.select(
        F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.col(row).alias("_at")),
        "_text", shingle).select("_id", "fp", "_at"), "fingerprints")
    placed = fps.join(_classes(fps, "_id", max_bits).select("fp", "component"), "fp")
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_at"))
    first = placed.groupBy("component").agg(F.min(order).alias("first")) \
        .select(F.col("first._at").alias("_at"))
    losers = materialize(fps.join(first, "_at", "left_anti").select(F.col("_at").alias(row)),
                         "near-copies")
    return kept.join(losers, row, "left_anti").select(*docs.columns)
