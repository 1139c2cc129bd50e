"""Retrieval (D1-D10): metadata filter, exact k-nearest chunks, similarity,
relevance threshold, per-question settings, report and source listing.

Exact kNN without a cross join
------------------------------
Every question must be compared with every candidate chunk; what must not
happen is materialising those pairs as rows. The plan is:

1. The questions are a stated set. Up to one block of bounded size they are
   broadcast. More are cut into blocks that never pass the driver: questions
   and corpus form a grid of question blocks and corpus splits, each question
   goes to every split and each vector to every block, and a task holds one
   cell (one block and one split) whatever the number of questions.
2. Below the grid's size the chunk table is scanned with only ``id``, the vector and the filter
   columns in use, and streamed through ``mapInArrow``. A task keeps the best
   ``k`` chunks of every question over all its batches: a BLAS product in
   single precision gives approximate distances, rows that can still beat a
   question's k-th best (within a bound above the rounding error) get their
   exact distance and are merged in. Questions of one filter are compared only
   with the rows it fits. A task emits at its end: at most ``k`` rows per
   question, however big or duplicated its partition is. Only questions for
   thousands of rows are answered batch by batch, so nothing is held for them.
3. A global ``row_number() over (partition by question order by distance,
   id)`` keeps the final k. Spark plans it with ``WindowGroupLimit`` on both
   sides of the shuffle.

Reported distances are summed over dimensions in index order in float64,
the same order the SQL check uses, so ranks agree exactly with an
independent engine.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import empty_frame

# Fixed values from the reference's retrieval settings.
DEFAULT_N_RESULTS = 5

# Bytes of one question block, and of a result side that is broadcast.
DEFAULT_MAX_BROADCAST_BYTES = 64 << 20
RESULT_ROW_BYTES = 64
# Distance matrix cells per numpy block (rows x questions), bounds task memory.
_BLOCK_CELLS = 2_000_000
# Bytes of the vectors in one corpus split of the question grid.
SPLIT_BYTES = 16 << 20
# Bytes of one question block at most, so that a cell takes seconds.
QUESTION_BLOCK_BYTES = 8 << 20
# Questions for this many rows or more are listed, not kept sorted.
LISTING_K = 1 << 12
_MAX_TASKS = 50_000


# ---------------------------------------------------------------------------
# D1 where filter
# ---------------------------------------------------------------------------
def where_condition(metadata: Column, filter_type: Column | str | None = None,
                    filter_author: Column | str | None = None) -> Column:
    """Equality on ``type`` and/or ``author``, ANDed; unset or empty -> no test.

    A chunk without the key does not match (NULL comparison drops it).
    """
    cond = F.lit(True)
    for key, val in (("type", filter_type), ("author", filter_author)):
        if val is None:
            continue
        v = F.lit(val) if isinstance(val, str) else val
        unset = v.isNull() | (v == "")
        cond = cond & (unset | F.coalesce(metadata[key] == v, F.lit(False)))
    return cond


def where_filter(chunks: DataFrame, filter_type: str | None = None,
                 filter_author: str | None = None, metadata_col: str = "metadata") -> DataFrame:
    """Chunks whose metadata match the configured filters (D1)."""
    if not filter_type and not filter_author:
        return chunks
    return chunks.filter(where_condition(F.col(metadata_col), filter_type or None,
                                         filter_author or None))


# ---------------------------------------------------------------------------
# D3/D5 distance and similarity as column expressions
# ---------------------------------------------------------------------------
def l2sq(a: Column, b: Column) -> Column:
    """Squared L2 distance of two float arrays, summed in index order."""
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))
                       * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    """``1 / (1 + distance)``."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


# ---------------------------------------------------------------------------
# D2/D4/D8 exact kNN
# ---------------------------------------------------------------------------
def _exact_l2sq(cmat: np.ndarray, qmat: np.ndarray, ri: np.ndarray, qi: np.ndarray) -> np.ndarray:
    """Squared L2 of the (row, question) pairs, summed over dimensions in index
    order (the definition the SQL check uses, so values agree bit for bit)."""
    acc = np.zeros(ri.size, dtype=np.float64)
    for j in range(cmat.shape[1]):
        t = cmat[ri, j] - qmat[qi, j]
        acc += t * t
    return acc


class _Nearest:
    """The best rows so far of questions that share one filter."""

    def __init__(self, vec: np.ndarray, k: np.ndarray):
        self.vec, self.k = vec, k
        self.norm = np.einsum("ij,ij->i", vec, vec)
        self.seen = 0
        self.q = np.empty(0, np.int64)
        self.d = np.empty(0)
        self.id = np.empty(0, object)
        self.limit = np.full(len(k), np.inf)  # distance of the k-th best

    def merge(self, rows: np.ndarray, norm: np.ndarray, ids: np.ndarray) -> None:
        """Rows are taken in parts as long as all rows before them, so that a
        part adds about ``k`` candidates to a question."""
        start = 0
        while start < len(rows):
            stop = start + max(256, 2 * int(self.k.max()), self.seen)
            part = slice(start, min(stop, len(rows)))
            self._merge(rows[part], norm[part], ids[part])
            self.seen += part.stop - start
            start = part.stop

    def _merge(self, rows, norm, ids):
        n, dim = rows.shape
        longest = math.sqrt(norm.max())
        # Products in single precision where it holds them; ``slack`` is above
        # their rounding error.
        kind, unit = (np.float32, 2.0 ** -23) if 1e-10 < longest < 1e15 \
            and math.sqrt(self.norm.max()) < 1e15 else (np.float64, 2.0 ** -52)
        slack = unit * (dim + 8) * (np.sqrt(self.norm) * longest + longest * longest) + 1e-36
        low, half = rows.astype(kind), (norm / 2).astype(kind)
        step = max(1, _BLOCK_CELLS // n)
        found, held = [], 0
        for q0 in range(0, len(self.k), step):
            q = slice(q0, min(q0 + step, len(self.k)))
            near = self.vec[q].astype(kind) @ low.T  # grows as the distance falls
            near -= half
            least = (self.norm[q] - self.limit[q]) / 2 - slack[q]
            new = np.flatnonzero(np.isinf(self.limit[q]) & (self.k[q] <= n))
            if len(new):
                nth = n - self.k[q][new]
                part = np.partition(near[new], np.unique(nth), axis=1)
                least[new] = part[np.arange(len(new)), nth] - 2 * slack[q][new]
            # Rounded towards more candidates.
            least = np.nextafter(least.astype(kind), kind(-np.inf))
            qi, ri = np.divmod(np.flatnonzero(near >= least[:, None]), n)
            qi += q0
            d = _exact_l2sq(rows, self.vec, ri, qi)
            keep = d <= self.limit[qi]
            found.append((qi[keep], d[keep], ids[ri[keep]]))
            held += len(found[-1][0])
            if held > _BLOCK_CELLS:
                self._keep(found)
                found, held = [], 0
        if held:
            self._keep(found)

    def _keep(self, found):
        q, d, i = (np.concatenate([old, *(f[j] for f in found)])
                   for j, old in enumerate((self.q, self.d, self.id)))
        order = np.lexsort((d, q))
        q, d, i = q[order], d[order], i[order]
        equal = (q[1:] == q[:-1]) & (d[1:] == d[:-1])
        if equal.any():  # only rows at the same distance are put in order of their ids
            tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
            order = np.lexsort((i[tied].astype(str), d[tied], q[tied]))
            i[tied] = i[tied][order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep, last = rank < self.k[q], rank == self.k[q] - 1
        self.limit[q[last]] = d[last]
        self.q, self.d, self.id = q[keep], d[keep], i[keep]


def _distances(dims: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Squared L2 of one question to all rows (``dims``: a row for each
    dimension), summed in index order as in :func:`_exact_l2sq`."""
    d = np.zeros(dims.shape[1])
    for row, x in zip(dims, vec):
        t = row - x
        d += t * t
    return d


class _Listing:
    """Questions that ask for a great many rows: nothing is kept, every part of
    the corpus gives its own best."""

    def __init__(self, vec: np.ndarray, k: np.ndarray):
        self.vec, self.k = vec, k

    def rows(self, rows: np.ndarray, ids: np.ndarray):
        """``question, distances, ids`` of the rows, question by question."""
        dims = np.ascontiguousarray(rows.T)
        for q, (vec, k) in enumerate(zip(self.vec, self.k)):
            d = _distances(dims, vec)
            if k >= len(d):
                yield q, d, ids
            else:
                best = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                yield q, d[best], ids[best]


class _Counting:
    """Questions whose answers are only counted: how many rows there are, and
    how many within each of a question's marks of similarity."""

    def __init__(self, vec: np.ndarray, marks: list):
        self.vec, self.marks = vec, marks
        self.n = [np.zeros(1 + len(m), np.int64) for m in marks]

    def count(self, rows: np.ndarray) -> None:
        dims = np.ascontiguousarray(rows.T)
        for vec, marks, n in zip(self.vec, self.marks, self.n):
            n[0] += len(rows)
            if len(marks):
                near = 1.0 / (1.0 + _distances(dims, vec))
                n[1:] += [np.count_nonzero(near >= m) for m in marks]


class _Best:
    """The best rows so far of one block of questions, by their filters."""

    def __init__(self, block: dict):
        self.pos, self.groups = np.asarray(block["pos"]), []
        vec, k = block["vec"], np.asarray(block["k"], np.int64)
        asked = np.isfinite(np.einsum("ij,ij->i", vec, vec)) & (k > 0)
        wants: dict[tuple, list[int]] = {}
        for q in np.flatnonzero(asked).tolist():
            want = tuple(None if f[q] is None or f[q] == "" else f[q] for f in block["filters"])
            wants.setdefault(want, []).append(q)
        for want, q in wants.items():
            q = np.array(q)
            if "marks" in block:
                self.groups.append((want, q, _Counting(vec[q], [block["marks"][i] for i in q])))
                continue
            for kind, some in ((_Nearest, q[k[q] < LISTING_K]), (_Listing, q[k[q] >= LISTING_K])):
                if len(some):
                    self.groups.append((want, some, kind(vec[some], k[some])))

    def add(self, rows: np.ndarray, ids: np.ndarray, corpus_f: list[np.ndarray]):
        """Take rows in; yields ``positions, ids, distances`` of listings."""
        norm = np.einsum("ij,ij->i", rows, rows)
        finite = np.isfinite(norm)
        if not finite.all():
            rows, norm, ids = rows[finite], norm[finite], ids[finite]
            corpus_f = [f[finite] for f in corpus_f]
        places = [{} for _ in corpus_f]  # rows of each value of each filter
        for place, f in zip(places, corpus_f):
            values, codes = np.unique(["" if v is None else f"v{v}" for v in f], return_inverse=True)
            order = np.argsort(codes, kind="stable")
            place |= zip(values.tolist(), np.split(order, np.cumsum(np.bincount(codes))[:-1]))
        fit: dict[tuple, np.ndarray | None] = {}
        for want, questions, group in self.groups:
            if want not in fit:
                some = None
                for place, value in zip(places, want):
                    if value is not None:
                        have = place.get(f"v{value}", np.empty(0, np.int64))
                        some = have if some is None else np.intersect1d(some, have, True)
                fit[want] = some
            some = fit[want]
            mine, its = (rows, ids) if some is None else (rows[some], ids[some])
            if not len(mine):
                continue
            if isinstance(group, _Counting):
                group.count(mine)
            elif isinstance(group, _Listing):
                for q, d, i in group.rows(mine, its):
                    yield np.full(len(d), self.pos[questions[q]]), i, d
            else:
                group.merge(mine, norm if some is None else norm[some], its)

    def rest(self):
        """``positions, ids, distances`` of the best rows that were kept."""
        for _, questions, group in self.groups:
            if isinstance(group, _Nearest) and len(group.q):
                yield self.pos[questions[group.q]], group.id, group.d


    def counts(self) -> pa.RecordBatch:
        """``_pos, mark, n`` of counted questions; a null mark for all rows."""
        found = [(int(self.pos[q]), mark, int(n)) for _, questions, group in self.groups
                 for q, marks, ns in zip(questions, group.marks, group.n)
                 for mark, n in zip([None, *marks], ns)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*found) if found else ((), (), ()),
                                            (pa.int64(), pa.float64(), pa.int64()))],
            names=_COUNT_NAMES)


def _vectors(ids, vectors, filters, dim: int):
    """A batch of corpus rows that have a vector: vectors as a matrix, ids,
    filter columns."""
    have = vectors.is_valid()
    ids, vectors, filters = ids.filter(have), vectors.filter(have), [f.filter(have) for f in filters]
    widths = np.diff(vectors.offsets.to_numpy())
    if (widths != dim).any():
        raise ValueError(f"vectors of {widths[widths != dim][0]} dimensions "
                         f"among questions of {dim}")
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return (rows, np.array(ids.to_pylist(), object),
            [np.array(c.to_pylist(), object) for c in filters])


_TOP_NAMES = ["_pos", "id", "distance"]
_COUNT_NAMES = ["_pos", "mark", "n"]
_COUNT_SCHEMA = "_pos long, mark double, n long"


def _emit(found, metric: str) -> list[pa.Array]:
    pos, ids, d = found
    return [pa.array(pos, pa.int64()), pa.array(ids, pa.string()),
            pa.array(np.sqrt(d) if metric == "l2" else d, pa.float64())]


def _local_topk(block, dim: int, metric: str):
    def run(batches):
        best = None
        for batch in batches:
            rows, ids, corpus_f = _vectors(batch.column(0), batch.column(1), batch.columns[2:], dim)
            if len(rows):
                best = best or _Best(block.value)
                for found in best.add(rows, ids, corpus_f):
                    yield pa.RecordBatch.from_arrays(_emit(found, metric), names=_TOP_NAMES)
        for found in best.rest() if best else ():
            yield pa.RecordBatch.from_arrays(_emit(found, metric), names=_TOP_NAMES)
    return run


def _local_counts(block, dim: int):
    def run(batches):
        best = _Best(block.value)
        for batch in batches:
            rows, ids, corpus_f = _vectors(batch.column(0), batch.column(1), batch.columns[2:], dim)
            if len(rows):
                list(best.add(rows, ids, corpus_f))
        yield best.counts()
    return run


def _cell_block(questions: pa.Table, dim: int, n_filters: int) -> dict:
    return {"pos": questions.column("_pos").to_numpy(),
            "vec": questions.column("_qvec").combine_chunks().flatten()
            .to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim),
            "k": questions.column("_k").to_numpy(),
            "filters": [np.array(questions.column(f"_f{i}").to_pylist(), object)
                        for i in range(n_filters)]}


def _cell_counts(dim: int, metric: str, n_filters: int):
    """Counts of one split for one block of questions."""
    def run(corpus: pa.Table, questions: pa.Table) -> pa.Table:
        best = _Best(_cell_block(questions, dim, n_filters)
                     | {"marks": questions.column("_marks").to_pylist()})
        for batch in corpus.to_batches(max_chunksize=1 << 16):
            rows, ids, corpus_f = _vectors(
                batch.column("_cid"), batch.column("_cvec"),
                [batch.column(f"_f{i}") for i in range(n_filters)], dim)
            if len(rows):
                list(best.add(rows, ids, corpus_f))
        return pa.Table.from_batches([best.counts()])
    return run


def _cell_topk(dim: int, metric: str, n_filters: int):
    """Best rows of one split for one block of questions."""
    def run(corpus: pa.Table, questions: pa.Table) -> pa.Table:
        out = [[pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.float64())]]
        if corpus.num_rows and questions.num_rows:
            best = _Best(_cell_block(questions, dim, n_filters))
            for batch in corpus.to_batches(max_chunksize=1 << 16):
                rows, ids, corpus_f = _vectors(
                    batch.column("_cid"), batch.column("_cvec"),
                    [batch.column(f"_f{i}") for i in range(n_filters)], dim)
                if len(rows):
                    out += [_emit(found, metric) for found in best.add(rows, ids, corpus_f)]
            out += [_emit(found, metric) for found in best.rest()]
        return pa.Table.from_arrays([pa.chunked_array(c) for c in zip(*out)], names=_TOP_NAMES)
    return run


def _grid_topk(side: DataFrame, questions: DataFrame, n_blocks: int, dim: int, metric: str,
               n_filters: int, counted: bool = False) -> DataFrame:
    """Fragment and replicate in two dimensions: cell ``(block, split)`` gets
    the questions of one block and the vectors of one split."""
    n_rows = side.count()
    n_splits = max(1, math.ceil(n_rows * (8 * dim + RESULT_ROW_BYTES) / SPLIT_BYTES))
    split = F.pmod(F.xxhash64("_cid"), F.lit(n_splits)).alias("_s")
    block = F.pmod(F.xxhash64("_pos"), F.lit(n_blocks)).alias("_b")
    left = side.select("*", split, F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("_b"))
    right = questions.filter("_qvec is not null").drop("query_id").select(
        "*", block, F.explode(F.sequence(
            F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long"))).alias("_s"))
    # A task for every cell: more vectors make more tasks, not longer ones.
    n = min(2 * n_blocks * n_splits, _MAX_TASKS)
    left, right = (x.repartition(n, "_b", "_s") for x in (left, right))
    cells = left.groupBy("_b", "_s").cogroup(right.groupBy("_b", "_s"))
    if counted:
        return cells.applyInArrow(_cell_counts(dim, metric, n_filters), _COUNT_SCHEMA)
    return cells.applyInArrow(_cell_topk(dim, metric, n_filters),
                              "_pos long, id string, distance double")


def knn(corpus: DataFrame, queries: DataFrame, k: int | str = DEFAULT_N_RESULTS, *,
        corpus_id: str = "id", corpus_vec: str = "embedding",
        query_id: str = "query_id", query_vec: str = "embedding",
        filters: dict[str, Column] | None = None, metric: str = "l2sq",
        max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Exact k nearest corpus rows per query row (see :func:`knn_bounded`)."""
    return knn_bounded(corpus, queries, k, corpus_id=corpus_id, corpus_vec=corpus_vec,
                       query_id=query_id, query_vec=query_vec, filters=filters,
                       metric=metric, max_broadcast_bytes=max_broadcast_bytes)[0]


def knn_bounded(corpus: DataFrame, queries: DataFrame, k: int | str = DEFAULT_N_RESULTS, *,
                corpus_id: str = "id", corpus_vec: str = "embedding",
                query_id: str = "query_id", query_vec: str = "embedding",
                filters: dict[str, Column] | None = None, metric: str = "l2sq",
                max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES
                ) -> tuple[DataFrame, int, int]:
    """Exact k nearest corpus rows per query row.

    ``k`` is a number or the name of a per-query column (NULL -> default 5).
    ``filters`` maps a query column name to a corpus column expression; when
    the query's value is set (non-null, non-empty) only corpus rows with an
    equal value are candidates, and the filter applies before the top-k.

    Rows without a vector are no candidates, and a query without one has no
    result. A repeated query id raises, and so does a vector of another number
    of dimensions than the queries'.

    Returns ``(result, n_questions, max_k)`` where result is ``query_id,
    rank, id, distance`` (``metric`` ``l2sq``: squared L2, the vector store
    default; ``l2``: its square root); ``n_questions * max_k`` bounds its rows.
    """
    if metric not in ("l2sq", "l2"):
        raise ValueError(f"unknown metric {metric}")
    spark = corpus.sparkSession
    filters = filters or {}
    fnames = [f"_f{i}" for i in range(len(filters))]
    kcol = (F.coalesce(F.col(k), F.lit(DEFAULT_N_RESULTS)) if isinstance(k, str)
            else F.lit(int(k))).cast("long")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_qvec"),
                       kcol.alias("_k"), *[F.col(qc).cast("string").alias(fn)
                                           for qc, fn in zip(filters, fnames)])
    ids = q.select("query_id", "_k")
    stats = ids.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("_k").alias("k")) \
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("k").alias("k")).first()
    n_q, kmax = int(stats["n"] or 0), int(stats["k"] or 0)
    if (stats["most"] or 0) > 1:
        raise ValueError("a query id occurs more than once")
    qid_type = queries.schema[query_id].dataType
    out_schema = T.StructType([T.StructField("query_id", qid_type),
                               T.StructField("id", T.StringType()),
                               T.StructField("distance", T.DoubleType())])
    if n_q == 0 or kmax <= 0:
        return empty_frame(spark, out_schema.add("rank", T.IntegerType())), 0, 0
    kept, dim, n_blocks = _written_questions(
        q, min(max_broadcast_bytes, QUESTION_BLOCK_BYTES), n_q)
    side = corpus.select(F.col(corpus_id).cast("string").alias("_cid"),
                         F.col(corpus_vec).alias("_cvec"),
                         *[expr.cast("string").alias(fn)
                           for expr, fn in zip(filters.values(), fnames)])
    if n_blocks == 1:
        local = side.mapInArrow(_local_topk(_question_block(spark, kept, fnames, dim), dim, metric),
                                "_pos long, id string, distance double")
    else:
        local = _grid_topk(side, kept, n_blocks, dim, metric, len(fnames))
    asked = kept.select("_pos", "query_id", "_k")
    # k per query travels with the final filter; the literal bound lets the
    # optimizer insert WindowGroupLimit before and after the shuffle.
    w = Window.partitionBy("_pos").orderBy("distance", "id")
    ranked = (local.withColumn("rank", F.row_number().over(w))
              .filter(F.col("rank") <= min(kmax, (1 << 31) - 1)))
    small = n_q * RESULT_ROW_BYTES <= max_broadcast_bytes  # one narrow row per question
    ranked = ranked.join(F.broadcast(asked) if small else asked, "_pos") \
        .filter(F.col("rank") <= F.col("_k"))
    return (ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance"),
            n_q, kmax)


def count_within(corpus: DataFrame, queries: DataFrame, marks: str, *,
                 query_id: str = "query_id", query_vec: str = "embedding",
                 filters: dict[str, Column] | None = None,
                 max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """How many corpus rows answer each question: ``query_id, mark, n``.

    For questions that ask for all rows and whose rows nobody reads: they are
    compared with every candidate as in :func:`knn`, but what leaves a task is
    a few numbers. ``marks`` names an ``array<double>`` column of similarities;
    ``n`` is the number of candidates at least as similar as ``mark``, and for
    the null mark that of all candidates. Questions without a candidate may be
    missing. ``query_id`` must be unique.
    """
    spark, filters = corpus.sparkSession, filters or {}
    fnames = [f"_f{i}" for i in range(len(filters))]
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_qvec"),
                       F.lit(1).cast("long").alias("_k"),
                       F.array_distinct(F.array_compact(marks)).alias("_marks"),
                       *[F.col(qc).cast("string").alias(fn) for qc, fn in zip(filters, fnames)])
    n_q, n_marks = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_marks")), F.lit(0))).first()
    if n_q == 0:
        return empty_frame(spark, T.StructType([queries.schema[query_id]]).add("mark", "double")
                           .add("n", "long"))
    kept, dim, n_blocks = _written_questions(
        q, min(max_broadcast_bytes, QUESTION_BLOCK_BYTES), n_q + n_marks // 8)
    side = corpus.select(F.lit("").alias("_cid"), F.col("embedding").alias("_cvec"),
                         *[expr.cast("string").alias(fn)
                           for expr, fn in zip(filters.values(), fnames)])
    if n_blocks == 1:
        local = side.mapInArrow(_local_counts(_question_block(spark, kept, fnames, dim), dim),
                                _COUNT_SCHEMA)
    else:
        side = side.withColumn("_cid", F.monotonically_increasing_id().cast("string"))
        local = _grid_topk(side, kept, n_blocks, dim, "l2sq", len(fnames), counted=True)
    return local.groupBy("_pos", "mark").agg(F.sum("n").alias("n")) \
        .join(kept.select("_pos", "query_id"), "_pos").select("query_id", "mark", "n")


def _written_questions(q: DataFrame, max_bytes: int, n_q: int) -> tuple[DataFrame, int, int]:
    """The questions, written once with a position each, their number of
    dimensions and the number of blocks of ``max_bytes`` they make up."""
    from quire.session import materialize  # noqa: PLC0415

    kept = materialize(q.withColumn("_pos", F.monotonically_increasing_id()), "questions")
    widths = [r[0] for r in kept.select(F.size("_qvec")).filter("_qvec is not null")
              .distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"questions of {widths[0]} and {widths[1]} dimensions")
    dim = widths[0] if widths else 0
    return kept, dim, max(1, math.ceil(n_q * (8 * dim + RESULT_ROW_BYTES) / max_bytes))


def _question_block(spark, kept: DataFrame, fnames: list[str], dim: int):
    """Broadcast of all questions, where they fit into one block."""
    pdf = kept.filter("_qvec is not null").drop("query_id").toPandas()
    marks = {"marks": pdf["_marks"].tolist()} if "_marks" in pdf else {}
    return spark.sparkContext.broadcast(marks | {
        "pos": pdf["_pos"].to_numpy(np.int64),
        "vec": np.array(pdf["_qvec"].tolist(), np.float64).reshape(len(pdf), dim),
        "k": pdf["_k"].to_numpy(np.int64),
        "filters": [pdf[f].where(pdf[f].notna(), None).to_numpy(dtype=object)
                    for f in fnames]})


# ---------------------------------------------------------------------------
# D6 relevance, D7/D8 retrieve
# ---------------------------------------------------------------------------
def filter_by_relevance(results: DataFrame, min_relevance: float | str | None) -> DataFrame:
    """Keep rows with ``similarity >= min_relevance`` (inclusive); ``None`` ->
    keep all. ``min_relevance`` may name a per-row column (NULL = off)."""
    if min_relevance is None:
        return results
    m = F.col(min_relevance) if isinstance(min_relevance, str) else F.lit(float(min_relevance))
    return results.filter(m.isNull() | (similarity(F.col("distance")) >= m))


def _field(chunks: DataFrame, key: str) -> Column:
    """Filter field of a chunk: a column of its own in stored collections,
    whose row groups a filter can skip, else the metadata entry."""
    return F.col(key) if key in chunks.columns else F.col("metadata")[key]


CHUNK_FIELDS = ["document", "source_file", "chunk_index", "total_chunks", "metadata"]


def question_filters(chunks: DataFrame) -> dict[str, Column]:
    """The filters of every question row, as :func:`knn` takes them."""
    return {f"filter_{key}": _field(chunks, key) for key in ("type", "author")}


def bounded(side: DataFrame, rows: int,
            max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """``side``, a narrow frame of at most ``rows`` rows, with a broadcast hint
    where its bytes are few enough."""
    return F.broadcast(side) if rows * RESULT_ROW_BYTES <= max_broadcast_bytes else side


def with_fields(chunks: DataFrame, top: DataFrame) -> DataFrame:
    """The rows of ``top`` with the fields of the chunks their ``id`` names."""
    return chunks.select(F.col("id").cast("string").alias("id"), *CHUNK_FIELDS).join(top, "id")


def retrieve(chunks: DataFrame, questions: DataFrame, *, question_id: str = "query_id",
             n_results: int | str = DEFAULT_N_RESULTS,
             min_relevance: float | str | None = None,
             filter_type: str | None = None, filter_author: str | None = None,
             per_row: bool = False, metric: str = "l2sq",
             max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
             keep_unfiltered: bool = False) -> DataFrame:
    """Top-k chunks per question with the reference's settings (D7/D8).

    ``questions`` holds ``question_id`` and ``embedding``. With
    ``per_row=True`` the columns ``n_results``, ``min_relevance``,
    ``filter_type``, ``filter_author`` of each question row are used (NULL ->
    default); otherwise the scalar arguments apply to all.

    Output: ``query_id, rank, id, document, source_file, chunk_index,
    total_chunks, metadata, distance, similarity`` (and ``kept`` when
    ``keep_unfiltered``: rows failing the threshold are kept and flagged).
    """
    q = questions.withColumnRenamed(question_id, "query_id") if question_id != "query_id" \
        else questions
    if per_row:
        for c, t in (("n_results", "long"), ("min_relevance", "double"),
                     ("filter_type", "string"), ("filter_author", "string")):
            if c not in q.columns:
                q = q.withColumn(c, F.lit(None).cast(t))
        k: int | str = "n_results"
        rel_col = "min_relevance"
    else:
        q = (q.withColumn("filter_type", F.lit(filter_type).cast("string"))
              .withColumn("filter_author", F.lit(filter_author).cast("string"))
              .withColumn("min_relevance", F.lit(min_relevance).cast("double")))
        k = int(n_results) if not isinstance(n_results, str) else n_results
        rel_col = "min_relevance"
    # A filter for all questions is applied before any vector is read by
    # Python; filter columns are passed on only for per-question filters.
    candidates, filt = chunks, {}
    if per_row:
        filt = question_filters(chunks)
    else:
        for key, value in (("type", filter_type), ("author", filter_author)):
            if value:
                candidates = candidates.filter(_field(chunks, key) == value)
    top, n_q, kmax = knn_bounded(candidates, q, k, filters=filt, metric=metric,
                                 max_broadcast_bytes=max_broadcast_bytes)
    # Bring back the chunk fields for the result rows only: the result has at
    # most n_q * kmax narrow rows, and its width is known.
    def sized(side: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(side) if rows * RESULT_ROW_BYTES <= max_broadcast_bytes else side
    res = with_fields(chunks, sized(top, n_q * kmax))
    rel = q.select("query_id", F.col(rel_col).alias("_min_rel"))
    res = res.join(sized(rel, n_q), "query_id")
    res = res.withColumn("similarity", similarity(F.col("distance")))
    kept = F.col("_min_rel").isNull() | (F.col("similarity") >= F.col("_min_rel"))
    cols = ["query_id", "rank", "id", *CHUNK_FIELDS, "distance", "similarity"]
    if keep_unfiltered:
        return res.withColumn("kept", kept).select(*cols, "kept")
    return res.filter(kept).select(*cols)


# ---------------------------------------------------------------------------
# D9 report, D10 sources
# ---------------------------------------------------------------------------
def retrieval_report(results: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Per question: rows returned, rows kept after the threshold, distance
    range (4 places, as logged) and the best source (default ``unknown``).

    ``results`` comes from ``retrieve(..., keep_unfiltered=True)``. With
    ``questions`` (a ``query_id`` column) those without any result are
    reported too, with counts of 0.
    """
    src = F.coalesce(F.col("source_file"), F.lit("unknown"))
    found = results.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_returned"),
        F.sum(F.when(F.col("kept"), 1).otherwise(0)).cast("int").alias("n_kept"),
        F.round(F.min("distance"), 4).alias("min_distance"),
        F.round(F.max("distance"), 4).alias("max_distance"),
        F.min_by(src, F.col("rank")).alias("top_source"),
    )
    if questions is None:
        return found
    return questions.select("query_id").join(found, "query_id", "left") \
        .fillna(0, ["n_returned", "n_kept"])


def retrieval_log(results: DataFrame) -> DataFrame:
    """One row per returned chunk, as logged: ``query_id, rank, distance`` (4
    places), ``source_file`` and whether the threshold kept it."""
    return results.select("query_id", "rank", F.round("distance", 4).alias("distance"),
                          F.coalesce("source_file", F.lit("unknown")).alias("source_file"), "kept")


def sources(results: DataFrame) -> DataFrame:
    """Source listing per question (D10): position, file, title cut to 40
    characters (default ``untitled``), type (default empty)."""
    w = Window.partitionBy("query_id").orderBy("rank")
    md = F.col("metadata")
    # The metadata stay behind: only what is listed is shuffled and sorted.
    source_file = F.coalesce(md["source_file"], F.col("source_file"), F.lit("unknown")) \
        if "source_file" in results.columns else F.coalesce(md["source_file"], F.lit("unknown"))
    listed = results.select(
        "query_id", "rank",
        source_file.alias("source_file"),
        F.substring(F.coalesce(md["title"], F.lit("untitled")), 1, 40).alias("title"),
        F.coalesce(md["type"], F.lit("")).alias("type"),
    )
    return listed.select("query_id", F.row_number().over(w).cast("int").alias("position"),
                         "source_file", "title", "type")
