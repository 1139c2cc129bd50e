"""Benchmark passages in training documents: word-pair seeds and
Smith-Waterman alignment.

The benchmark is a stated query set. It is held against all documents in
blocks of bounded size, each broadcast to the tasks. Seeds are pairs of words
that stand beside each other or have one word between them. An alignment of
the threshold shares pairs at a known number of an item's places
(``shared_places``), so the most frequent places, a few less than that, are
left out and no alignment is lost; a first pass counts in how many documents
every pair occurs. A second pass finds seeds in the documents, cuts a passage around the
diagonals they lie on and aligns it with the item, so that copies with words
changed, added or left out are scored. Excerpts of long items count by their
own length. Texts are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.sharing import Shared

EXCERPT = 13         # words of an item that are a leak whatever its length
EXCERPT_ERROR = -4   # score of a change in an excerpt: two more words make up for it
HITS = 3  # seed places of an item a document must share, or all it has to share
MATCH, MISMATCH, GAP = 2, -1, -1  # alignment scores of a word
THRESHOLD = 0.5      # alignment score as a share of a perfect copy's
BLOCK_BYTES = 8 << 20  # benchmark text of one block, which is broadcast

_WORD = re.compile(r"[^\W_]+")
_ARROW_NAMES = {"bigint": "int64", "int": "int32", "string": "string"}  # types of item ids


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; their places are those of ``_WORD`` in the text."""
    text = text or ""
    lower = text.lower()
    if len(lower) == len(text):
        return _WORD.findall(lower)
    # A letter that becomes two must not split its word.
    found = _WORD.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


# --- alignment ------------------------------------------------------------
def _table(a: np.ndarray, b: np.ndarray, mismatch: int, gap: int) -> tuple[int, int, int]:
    """Best local alignment score of two id sequences and its last cell.
    Negative ids match nothing. Rows run over ``a``; the gaps along a row are
    a running maximum."""
    ramp = np.arange(len(b) + 1) * -gap
    above, best = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
    for i, x in enumerate(a):
        step = np.where((b == x) & (x >= 0), MATCH, mismatch)
        row = np.maximum(above + gap, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + step)
        row = np.maximum.accumulate(row + ramp) - ramp
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j - 1)
        above = row
    return best


def align(a: np.ndarray, b: np.ndarray, mismatch: int = MISMATCH,
          gap: int = GAP) -> tuple[int, int, int]:
    """Smith-Waterman score of ``a`` and ``b`` and the span of ``b``."""
    score, i, j = _table(a, b, mismatch, gap)
    if not score:
        return 0, 0, 0
    _, _, back = _table(a[i::-1], b[j::-1], mismatch, gap)
    return score, j - back, j + 1


# --- one block of the benchmark -------------------------------------------
@dataclass
class Block:
    """Items with at least one word, as word ids of a shared vocabulary."""

    item_ids: list
    items: list[np.ndarray]
    vocabulary: dict[str, int]

    def pairs(self, ids: np.ndarray, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of two known words beside each other or with one
        word between, and of the single ones if ``words``."""
        known, size = ids >= 0, len(self.vocabulary)
        places, keys = [], []
        for step in (1, 2):
            at = np.flatnonzero(known[:-step] & known[step:])
            places.append(at)
            keys.append(ids[at] * size + ids[at + step])
        if words:
            places.append(np.flatnonzero(known))
            keys.append(-1 - ids[places[-1]])
        return np.concatenate(places), np.concatenate(keys)

    def item_pairs(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids = self.items[i]
        return self.pairs(ids, words=len(ids) == 1)

    def ids(self, words: list[str]) -> np.ndarray:
        return np.array(list(map(self.vocabulary.get, words, repeat(-1))), np.int64)


def make_block(rows: list[tuple]) -> Block:
    vocabulary: dict[str, int] = {}
    ids, items = [], []
    for item_id, text in rows:
        words = words_of(text)
        if words:
            ids.append(item_id)
            items.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words],
                                  np.int64))
    return Block(ids, items, vocabulary)


def shared_places(m: int, threshold: float) -> int:
    """Places of an item of ``m`` words whose pairs an alignment of the
    threshold shares at least. It has M matches and E <= 2 M - 2 m threshold
    errors. Of the M - 1 steps between matches at most E / 2 hold two errors
    or more; the others join two words that are a pair in both texts. Items
    for which that leaves none must share one pair all the same."""
    return max(math.ceil(threshold * m - 1e-9) - 1, 1)


@dataclass
class Seeds:
    keys: np.ndarray   # sorted seed keys, repeated for each place
    item: np.ndarray   # item of each
    place: np.ndarray  # word position in the item
    need: np.ndarray   # places of each item a document must share


def choose_seeds(block: Block, frequency: dict[int, int], threshold: float) -> Seeds:
    """All places of an item but the most frequent ones: as many stay that an
    alignment of the threshold shares ``need`` of them. Of the places an
    excerpt covers, the rarer half stays: a straight one, or one with two
    changes, has at most three that are not shared."""
    found, need = [], []
    for i, ids in enumerate(block.items):
        at, keys = block.item_pairs(i)
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, at, [frequency.get(int(k), 0) for k in keys])
        least = shared_places(len(ids), threshold)
        need.append(min(least, HITS))
        rare = np.argsort(count[:max(len(ids) - 1, 1)], kind="stable")
        chosen = np.zeros(len(ids), bool)
        chosen[rare[:len(rare) - least + need[-1]]] = True
        if len(rare) >= EXCERPT - 1:
            runs = np.lib.stride_tricks.sliding_window_view(count[:len(rare)], EXCERPT - 1)
            half = np.argsort(runs, axis=1, kind="stable")[:, :EXCERPT // 2]
            chosen[half + np.arange(len(runs))[:, None]] = True
        found += [(int(k), i, int(p)) for k, p in zip(keys, at) if chosen[p]]
    found.sort()
    table = np.array(found, np.int64).reshape(-1, 3)
    return Seeds(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), np.array(need))


def _may_hold_excerpt(shared: np.ndarray) -> bool:
    """An excerpt has E errors and 13 + 2 E matches or more. In the part of the
    item it covers the shared places outnumber the others by 12: a change costs
    one place, two between the same matches one more."""
    level = np.append(0, np.cumsum(np.where(shared, 1, -1)))
    return bool((level - np.minimum.accumulate(level)).max() >= EXCERPT - 1)


@dataclass
class Matcher:
    block: Block
    seeds: Seeds
    threshold: float

    def spans(self, text: str | None) -> list[tuple[object, float, int, int]]:
        """``(item_id, score, start, end)`` of the best passage for every
        item found in the text, as word positions."""
        ids = self.block.ids(words_of(text))
        seeds = self.seeds
        at, keys = self.block.pairs(ids, words=bool(seeds.keys[0] < 0))
        lo = np.searchsorted(seeds.keys, keys)
        n = np.searchsorted(seeds.keys, keys, side="right") - lo
        hit = np.flatnonzero(n)
        if not len(hit):
            return []
        n = n[hit]
        which = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = seeds.item[which]
        enough = np.bincount(item, minlength=len(seeds.need)) >= seeds.need
        keep = np.flatnonzero(enough[item])
        if not len(keep):
            return []
        item, place = item[keep], seeds.place[which[keep]]
        diagonal = np.repeat(at[hit], n)[keep] - place
        order = np.lexsort((diagonal, item))
        item, place, diagonal = item[order], place[order], diagonal[order]
        size = np.array([len(x) for x in self.block.items])[item]
        new = np.flatnonzero((np.diff(item) != 0) | (np.diff(diagonal) > size[1:])) + 1
        first, last = np.append(0, new), np.append(new, len(item))
        many = last - first >= seeds.need[item[first]]
        best: dict[int, tuple[float, int, int]] = {}
        for a, b in zip(first[many].tolist(), last[many].tolist()):
            i, m = int(item[a]), int(size[a])
            if len(set(place[a:b].tolist())) < seeds.need[i]:
                continue
            # An alignment of the threshold has at most m errors.
            start = max(int(diagonal[a]) - m - 1, 0)
            passage = ids[start:int(diagonal[b - 1]) + 2 * m + 1]
            words = self.block.items[i]
            # No alignment scores more than the pairs and words it could match.
            places, own = self.block.item_pairs(i)
            shared = np.zeros(m, bool)
            shared[places[np.isin(own, self.block.pairs(passage, words=m == 1)[1])]] = True
            common = np.isin(words, passage).sum()
            found = []
            if shared.sum() >= shared_places(m, self.threshold) \
                    and common >= self.threshold * m - 1e-9:
                score, s, e = align(words, passage)
                if score / (MATCH * m) >= self.threshold:
                    found = [(score / (MATCH * m), s, e)]
            if not found and common >= EXCERPT and _may_hold_excerpt(shared):
                score, s, e = align(words, passage, EXCERPT_ERROR, EXCERPT_ERROR)
                if score >= MATCH * EXCERPT:
                    found = [(score / (MATCH * m), s, e)]
            for share, s, e in found:
                if share > best.get(i, (0.0,))[0]:
                    best[i] = (share, start + s, start + e)
        return [(self.block.item_ids[i], *best[i]) for i in sorted(best)]


# --- Spark ----------------------------------------------------------------
def _count_pairs(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        known = np.unique(np.concatenate([block.item_pairs(i)[1]
                                          for i in range(len(block.items))]))
        count = np.zeros(len(known), np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                keys = np.unique(block.pairs(block.ids(words_of(text)), known[0] < 0)[1])
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                count[at[known[at] == keys]] += 1
        some = count > 0
        yield pd.DataFrame({"pair": known[some], "n": count[some]})
    return run


def matchers(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
             threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> Iterator[Matcher]:
    """A matcher for every block of the benchmark, with seeds chosen by pair
    frequencies over all documents. They decide what is looked at, not what
    is found. The driver holds one block."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("id"), F.col("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        block = make_block([tuple(r) for r in part.orderBy("id", "text").collect()])
        if not block.items:
            continue
        shared = Shared(spark, block)
        counted = docs.select(F.col(text).alias("text")) \
            .mapInPandas(_count_pairs(shared), "pair long, n long") \
            .groupBy("pair").agg(F.sum("n").alias("n"))
        frequency = {r.pair: r.n for r in counted.collect()}  # pairs of one block
        yield Matcher(block, choose_seeds(block, frequency, threshold), threshold)


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, score, start, end)``: the best passage of every
    document for every benchmark item that scores ``threshold`` or more, or
    else is an excerpt (``EXCERPT`` straight words of the item, two more for
    each change), with its place in the text (characters, end exclusive). The
    score of an excerpt is a share of the whole item too.

    Null and empty texts and items match nothing; repeated documents give
    repeated rows and repeated items one row each; a null id is returned as
    it is; other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_id].dataType
    schema = (f"{id_col} {id_type.simpleString()}, {item_id} {item_type.simpleString()}, "
              "score double, start long, end long")
    names = [id_col, item_id, "score", "start", "end"]
    item_arrow = pa.type_for_alias(_ARROW_NAMES[item_type.simpleString()])
    found = None
    for matcher in matchers(docs, items, text, item_id, threshold):
        shared = Shared(spark, matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [[], [], [], [], []]
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    spans = shared.value.spans(body)
                    place = [w.span() for w in _WORD.finditer(body)] if spans else []
                    for item, score, s, e in spans:
                        for column, value in zip(out, (doc, item, score, place[s][0],
                                                       place[e - 1][1])):
                            column.append(value)
                types = [batch.column(0).type, item_arrow, pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, types)], names=names)
        part = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")) \
            .mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found


def _is_clean(shared: Shared):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not shared.value.spans(t) for t in texts], dtype=bool)
    return clean


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text",
                      threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    kept = docs
    for matcher in matchers(docs, items, text, threshold=threshold):
        kept = kept.filter(_is_clean(Shared(docs.sparkSession, matcher))(F.col(text)))
    return kept
