"""Ranked lexical search of many items at once, with shared partial scores.

The corpus is read once into an index of the items' terms: per document its
length and the frequencies of those terms. Items share terms, so their scores
are evaluated as a graph: term sets that several items have in common are
mined (terms of the very same items first, then pairs of sets, again and
again), a document's partial score of each such set is added up once, and the
items' scores are put together from the sets. Each task keeps the best
documents of every item over all its rows; a window keeps the best of all.

Scores are whole numbers: a term's weight times a saturating part of its
frequency that depends on the document's length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.sharing import Shared
from quire.session import materialize

TOP = 50
LENGTH_PART = 50           # of 100: how much a document's length counts
SATURATION = 20
BLOCK_BYTES = 512 << 10    # item texts evaluated together; bounds terms, graph and broadcast
MINED_SETS = 4096          # term sets between which common pairs are looked for
_CELLS = 4_000_000         # partial scores (sets x documents) held at a time

# Bytes of a term, ASCII letters lower-cased; all others are borders. Bytes of
# characters beyond ASCII belong to terms.
_FOLD = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters, digits and all characters
    beyond ASCII, with A-Z lower-cased; null has none."""
    return text.translate(_FOLD).split() if text else []


# --- the graph ------------------------------------------------------------
@dataclass
class SharingGraph:
    """Nodes ``0 .. n_terms - 1`` are terms; node ``n_terms + i`` is the sum
    of ``parts[i]``, earlier nodes. ``items`` holds each item's nodes; those
    of one item have no term in common."""

    n_terms: int
    parts: list[tuple[int, ...]]
    items: list[tuple[int, ...]]

    @property
    def n_nodes(self) -> int:
        return self.n_terms + len(self.parts)

    def additions(self) -> int:
        return sum(len(p) - 1 for p in self.parts) + sum(max(len(i) - 1, 0) for i in self.items)

    def levels(self) -> list[list[int]]:
        """Numbers of ``parts`` in steps that use results of earlier ones only."""
        depth, out = [], []
        for part in self.parts:
            d = max((depth[x - self.n_terms] + 1 for x in part if x >= self.n_terms), default=0)
            depth.append(d)
            if d == len(out):
                out.append([])
            out[d].append(len(depth) - 1)
        return out


def sharing_graph(items: list[list[int]], n_terms: int, mined: int = MINED_SETS) -> SharingGraph:
    """Mine the sets of terms that items share.

    Terms held by the very same two or more items are one set from the start.
    Then sets that occur together in most items are joined to one, until no
    two sets share two items. Pairs are looked for among the ``mined`` sets
    of most items; scores do not depend on it.
    """
    holders: dict[int, list[int]] = {}
    for i, item in enumerate(items):
        for t in set(item):
            holders.setdefault(t, []).append(i)
    classes: dict[tuple[int, ...], list[int]] = {}
    for t in sorted(holders):
        classes.setdefault(tuple(holders[t]), []).append(t)
    parts: list[tuple[int, ...]] = []
    rest: list[list[int]] = [[] for _ in items]
    columns, node = [], []
    for held, members in sorted(classes.items(), key=lambda c: (-len(c[0]), c[1])):
        if len(held) == 1:  # of one item alone: nothing to share
            rest[held[0]] += members
            continue
        if len(members) > 1:
            parts.append(tuple(members))
            node.append(n_terms + len(parts) - 1)
        else:
            node.append(members[0])
        columns.append(held)
    for held, own in zip(columns[mined:], node[mined:]):
        for i in held:
            rest[i].append(own)
    node = node[:mined]
    has = np.zeros((len(items), len(node)), bool)
    for c, held in enumerate(columns[:mined]):
        has[list(held), c] = True
    while has.shape[1] > 1:
        f = has.astype(np.float32)
        both = np.triu(f.T @ f, 1)
        best = both.max()
        if best < 2:
            break
        # The most frequent pairs of this round, each set in one pair only.
        a, b = np.nonzero(both >= max(2, best / 2))
        order = np.lexsort((b, a, -both[a, b]))
        used, joined = np.zeros(has.shape[1], bool), []
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            if not used[x] and not used[y]:
                used[x] = used[y] = True
                joined.append((x, y))
        x, y = (np.array(z) for z in zip(*joined))
        new = has[:, x] & has[:, y]
        has[:, x] &= ~new
        has[:, y] &= ~new
        for p, q in joined:
            parts.append((node[p], node[q]))
            node.append(n_terms + len(parts) - 1)
        has = np.concatenate([has, new], axis=1)
        # Sets left with one item, or none, are shared no further.
        n = has.sum(axis=0)
        for c in np.flatnonzero(n == 1).tolist():
            rest[int(np.flatnonzero(has[:, c])[0])].append(node[c])
        has, node = has[:, n > 1], [node[c] for c in np.flatnonzero(n > 1).tolist()]
    for i, c in zip(*(z.tolist() for z in np.nonzero(has))):
        rest[i].append(node[c])
    return SharingGraph(n_terms, parts, [tuple(sorted(r)) for r in rest])


class Evaluator:
    """Scores of all items for documents in blocks."""

    def __init__(self, graph: SharingGraph, weights: np.ndarray, n_docs: int, n_all: int):
        self.graph, self.weights, self.n_docs, self.n_all = graph, weights, n_docs, n_all
        self.steps = []
        for level in graph.levels():
            flat = np.array([x for i in level for x in graph.parts[i]], np.int64)
            sizes = np.array([len(graph.parts[i]) for i in level])
            self.steps.append((np.array(level) + graph.n_terms, flat,
                               np.cumsum(sizes) - sizes))
        some = [i for i, nodes in enumerate(graph.items) if nodes]
        sizes = np.array([len(graph.items[i]) for i in some], np.int64)
        self.scored = np.array(some, np.int64)
        self.flat = np.array([x for i in some for x in graph.items[i]], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.rows = max(1, _CELLS // max(graph.n_nodes + len(self.flat), 1))

    def __call__(self, n: np.ndarray, row: np.ndarray, term: np.ndarray,
                 tf: np.ndarray) -> np.ndarray:
        """``(items with a term, documents)`` scores of ``len(n)`` documents
        of ``n`` terms each; ``row``, ``term``, ``tf``: their entries."""
        partial = np.zeros((self.graph.n_nodes, len(n)), np.int64)
        m = 100 - LENGTH_PART + (LENGTH_PART * n * self.n_docs) // max(self.n_all, 1)
        partial[term, row] = self.weights[term] * (
            (1_000_000_000 * tf) // (1000 * tf + SATURATION * m[row]))
        for nodes, flat, starts in self.steps:
            partial[nodes] = np.add.reduceat(partial[flat], starts, axis=0)
        return np.add.reduceat(partial[self.flat], self.starts, axis=0)


class _Best:
    """The best documents so far of every item."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.limit = np.ones(n_items, np.int64)  # score that still counts
        self.item, self.null, self.id, self.score = (np.empty(0, t) for t in
                                                     (np.int64, bool, np.int64, np.int64))

    def add(self, items: np.ndarray, scores: np.ndarray, null: np.ndarray,
            ids: np.ndarray) -> None:
        i, d = np.nonzero(scores >= self.limit[items][:, None])
        if not len(i):
            return
        item = np.concatenate([self.item, items[i]])
        score = np.concatenate([self.score, scores[i, d]])
        off, doc = np.concatenate([self.null, null[d]]), np.concatenate([self.id, ids[d]])
        order = np.lexsort((doc, off, -score, item))
        item, score, off, doc = item[order], score[order], off[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep, last = place < self.top, place == self.top - 1
        self.limit[item[last]] = score[last]
        self.item, self.score, self.null, self.id = (x[keep] for x in (item, score, off, doc))


# --- index ----------------------------------------------------------------
def _index_rows(shared: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            lengths, held, counts = [], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                found = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                term, tf = np.unique(found[found >= 0], return_counts=True)
                lengths.append(len(words))
                held.append(term.astype("<i4").tobytes())
                counts.append(tf.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(held, pa.binary()),
                 pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "tf"])
    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term in a task."""
    count = np.zeros(0, np.int64)
    for batch in batches:
        found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"))
        if len(found) > len(count):
            count = np.pad(count, (0, len(found) - len(count)))
        count[:len(found)] += found
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["term", "n"])


def _best_rows(shared: Shared, n_items: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluate, best = shared.value, _Best(n_items, top)
        for batch in batches:
            for lo in range(0, batch.num_rows, evaluate.rows):
                part = batch.slice(lo, evaluate.rows)
                held = part.column(2).to_pylist()
                row = np.repeat(np.arange(part.num_rows), [len(h) // 4 for h in held])
                if not len(row):
                    continue
                term = np.frombuffer(b"".join(held), "<i4").astype(np.int64)
                tf = np.frombuffer(b"".join(part.column(3).to_pylist()), "<i4").astype(np.int64)
                n = part.column(1).to_numpy()
                ids = part.column(0)
                best.add(evaluate.scored, evaluate(n, row, term, tf),
                         ids.is_null().to_numpy(zero_copy_only=False),
                         ids.fill_null(0).to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.id, mask=best.null), pa.array(best.score)],
            names=["at", "doc_id", "score"])
    return run


def _search_block(docs: DataFrame, wanted: list[tuple[int, bytes]], top: int) -> DataFrame:
    """``at, doc_id, score`` of each task's best documents for the items of
    one block: ``(at, text)``."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    items = [[number.setdefault(t, len(number)) for t in dict.fromkeys(terms(text))]
             for _, text in wanted]
    index = materialize(docs.mapInArrow(_index_rows(Shared(spark, number)),
                                        "doc_id long, n long, terms binary, tf binary"), "index")
    stats = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("n")) \
        .first()
    n_docs, n_all = int(stats["docs"]), int(stats["n"] or 0)
    held = index.select("terms").mapInArrow(_holders, "term long, n long").groupBy("term") \
        .agg(F.sum("n").alias("n")).collect()  # at most one row for each term of the block
    weights = np.zeros(len(number), np.int64)
    for r in held:
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["n"] + 1)))
    # Terms of no document score nothing.
    known = {r["term"] for r in held}
    graph = sharing_graph([[t for t in item if t in known] for item in items], len(number))
    evaluate = Shared(spark, Evaluator(graph, weights, n_docs, n_all))
    places = spark.createDataFrame([(i, at) for i, (at, _) in enumerate(wanted)],
                                   "at long, item long")
    if not known:
        return places.limit(0).selectExpr("item AS at", "at AS doc_id", "at AS score")
    found = index.mapInArrow(_best_rows(evaluate, len(items), top),
                             "at long, doc_id long, score long")
    # One row per item of the block.
    return found.join(F.broadcast(places), "at").select(F.col("item").alias("at"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id",
           text: str = "text", item_col: str = "item_id", item_text: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_col, rank, doc_id, score``: each item's ``top`` documents of
    highest score above 0, equal scores by ascending id (null last).

    Items are the queries; they are read in blocks of ``block_bytes`` of text,
    one pass over the corpus for each block, and every item row is ranked for
    itself, also with a null or repeated id. A null or empty text has no
    terms: such an item has no rows, such a document is in none and does not
    count. Repeated document rows are documents of their own; other columns
    are ignored; an empty table of either kind gives an empty result.
    """
    spark = docs.sparkSession
    kept = materialize(items.select(
        F.col(item_col).alias("item"), F.col(item_text).cast("binary").alias("text"),
        F.monotonically_increasing_id().alias("at")), "items")
    sizes = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(sizes / block_bytes))
    corpus = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text).cast("binary").alias("text"))
    found = None
    for b in range(n_blocks):
        wanted = [(r["at"], r["text"] and bytes(r["text"])) for r in kept.filter(
            F.pmod(F.xxhash64("at"), F.lit(n_blocks)) == b).select("at", "text").collect()]
        if not wanted:
            continue
        part = materialize(_search_block(corpus, wanted, top), "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "at long, doc_id long, score long")
    best_first = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best_first)) \
        .filter(F.col("rank") <= top)
    return ranked.join(kept.select("at", "item"), "at").select(
        F.col("item").alias(item_col), "rank", "doc_id", "score")
