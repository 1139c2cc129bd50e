"""Filters, exact kNN, relevance threshold, per-row settings."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import retrieve
from quire.sources.collection import CHUNK_SCHEMA, read_collection


def relevance(spark, distances, min_rel):
    rows = [(1, i + 1, f"d{i}", float(d)) for i, d in enumerate(distances)]
    df = spark.createDataFrame(rows, "query_id long, rank int, id string, distance double")
    return [r.id for r in retrieve.filter_by_relevance(df, min_rel).orderBy("rank").collect()]


def test_relevance_keeps_inclusive_prefix(spark):
    assert relevance(spark, [0.1, 0.2], 0.5) == ["d0", "d1"]
    assert relevance(spark, [0.1, 0.5, 2.0], 0.5) == ["d0", "d1"]
    assert relevance(spark, [1.0, 2.0], 0.9) == []
    assert relevance(spark, [1.0], 0.5) == ["d0"]  # 1/(1+1) == 0.5 is kept
    assert relevance(spark, [5.0], None) == ["d0"]


def chunk_table(spark, rows):
    data = [(cid, f"doc {cid}", vec, f"{cid}.md", 0, 1, 3, meta) for cid, vec, meta in rows]
    return spark.createDataFrame(data, CHUNK_SCHEMA)


@pytest.mark.parametrize("ftype,fauthor,expected", [
    (None, None, {"a", "b", "c"}), ("deep", None, {"a", "b"}),
    (None, "Sam", {"a", "c"}), ("deep", "Sam", {"a"}), ("", "", {"a", "b", "c"})])
def test_where_filter(spark, ftype, fauthor, expected):
    t = chunk_table(spark, [("a", [0.0], {"type": "deep", "author": "Sam"}),
                            ("b", [0.0], {"type": "deep"}),
                            ("c", [0.0], {"author": "Sam"})])
    got = {r.id for r in retrieve.where_filter(t, ftype, fauthor).collect()}
    assert got == expected


def brute_force(corpus, queries, k):
    out = {}
    for qid, q in queries:
        d = sorted((float(((np.asarray(v, np.float64) - np.asarray(q, np.float64)) ** 2).sum()), cid)
                   for cid, v in corpus)
        out[qid] = [cid for _, cid in d[:k]]
    return out


def test_knn_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(7)
    corpus = [(f"c{i:03d}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    corpus += [(f"dup{i}", corpus[0][1]) for i in range(40)]  # a hot group of copies
    queries = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(25)]
    queries.append((99, corpus[0][1]))
    cdf = spark.createDataFrame(corpus, "id string, embedding array<float>").repartition(4)
    qdf = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = retrieve.knn(cdf, qdf, 5, max_broadcast_bytes=200).collect()  # forces batches
    res = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        res.setdefault(r.query_id, []).append(r.id)
    assert res == brute_force(corpus, queries, 5)


def test_a_cell_holds_one_block_and_one_split(spark, monkeypatch):
    """Questions times twenty: what a cell gets stays the same, and the result
    (filters, per-question k, ties, rows without a vector) that of one block."""
    rng = np.random.default_rng(8)
    rows = [(f"c{i:03d}", rng.normal(size=4).tolist() if i % 50 else None, "xyz"[i % 3])
            for i in range(400)]
    cdf = spark.createDataFrame(rows, "id string, embedding array<float>, kind string")
    monkeypatch.setattr(retrieve, "SPLIT_BYTES", 100 * (8 * 4 + retrieve.RESULT_ROW_BYTES))
    largest = {}
    for n in (50, 1000):
        qs = [(i, rng.normal(size=4).tolist() if i % 40 else None, i % 4, "xyz"[i % 3] if i % 2
               else None) for i in range(n)]
        qdf = spark.createDataFrame(qs, "query_id long, embedding array<float>, k int, kind string")
        how = {"filters": {"kind": F.col("kind")}}
        grid = retrieve.knn(cdf, qdf, "k", max_broadcast_bytes=25 * 96, **how)
        one = retrieve.knn(cdf, qdf, "k", **how)
        assert sorted(map(tuple, grid.collect())) == sorted(map(tuple, one.collect()))
        kept, dim, blocks = retrieve._written_questions(
            qdf.select("query_id", F.col("embedding").alias("_qvec"), F.col("k").alias("_k"),
                       F.col("kind").alias("_f0")), 25 * 96, n)
        side = cdf.select(F.col("id").alias("_cid"), F.col("embedding").alias("_cvec"),
                          F.col("kind").alias("_f0"))

        monkeypatch.setattr(retrieve, "_cell_topk", lambda *a: lambda c, q: pa.table(
            {"_pos": pa.array([c.num_rows], pa.int64()), "id": ["cell"],
             "distance": [float(q.num_rows)]}))
        cells = retrieve._grid_topk(side, kept, blocks, dim, "l2sq", 1).collect()
        monkeypatch.undo()
        monkeypatch.setattr(retrieve, "SPLIT_BYTES", 100 * (8 * 4 + retrieve.RESULT_ROW_BYTES))
        largest[n] = max(c._pos for c in cells), max(c.distance for c in cells)
        assert len(cells) == blocks * 4
    assert largest[1000][0] < 200 and largest[1000][1] < 60  # a hundred vectors, 25 questions


def test_knn_per_row_k_and_filters(spark):
    corpus = chunk_table(spark, [("a", [0.0, 0.0], {"type": "x"}), ("b", [1.0, 0.0], {"type": "y"}),
                                 ("c", [2.0, 0.0], {"type": "x"}), ("d", [3.0, 0.0], {})])
    q = spark.createDataFrame(
        [(1, [0.0, 0.0], 2, None, None, None), (2, [0.0, 0.0], None, None, "x", None),
         (3, [0.0, 0.0], 10, 0.4, None, None)],
        "query_id long, embedding array<float>, n_results int, min_relevance double, "
        "filter_type string, filter_author string")
    r = retrieve.retrieve(corpus, q, per_row=True)
    got = {}
    for row in r.orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.id)
    assert got[1] == ["a", "b"]
    assert got[2] == ["a", "c"]
    assert got[3] == ["a", "b"]  # similarity 1, 0.5; 0.2 and 0.1 are under 0.4


def test_report_and_sources(spark):
    corpus = chunk_table(spark, [("a", [0.0], {"title": "T" * 60, "type": "deep"}),
                                 ("b", [1.0], {})])
    q = spark.createDataFrame([(1, [0.0])], "query_id long, embedding array<float>")
    res = retrieve.retrieve(corpus, q, n_results=2, min_relevance=0.9, keep_unfiltered=True)
    rep = retrieve.retrieval_report(res).collect()[0]
    assert (rep.n_returned, rep.n_kept, rep.top_source) == (2, 1, "a.md")
    src = retrieve.sources(retrieve.retrieve(corpus, q, n_results=2)).orderBy("position").collect()
    assert [(s.position, s.source_file, s.title, s.type) for s in src] == [
        (1, "a.md", "T" * 40, "deep"), (2, "b.md", "untitled", "")]


def test_missing_collection_reads_empty(spark, tmp_path):
    assert read_collection(spark, str(tmp_path), "nope").count() == 0


def test_l2_distance_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    assert df.select(retrieve.l2sq(F.col("a"), F.col("b"))).collect()[0][0] == 25.0


def test_task_emits_at_most_k_rows_per_question(spark):
    rng = np.random.default_rng(3)
    corpus = [(f"c{i:04d}", rng.normal(size=4).tolist()) for i in range(2000)]
    cdf = spark.createDataFrame(corpus, "id string, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(3)],
                              "query_id long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # 20 batches
    try:
        kept, dim, n_blocks = retrieve._written_questions(
            q.select("query_id", F.col("embedding").alias("_qvec"),
                     F.lit(5).cast("long").alias("_k")), 1 << 20, 3)
        assert n_blocks == 1
        block = retrieve._question_block(spark, kept, [], dim)
        local = cdf.mapInArrow(retrieve._local_topk(block, dim, "l2sq"),
                               "_pos long, id string, distance double")
        assert local.count() == 15
        got = {}
        for r in retrieve.knn(cdf, q, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_force(corpus, [tuple(r) for r in q.collect()], 5)


def test_equal_double_vectors_are_at_distance_zero(spark):
    v = [0.1, 1 / 3]
    c = spark.createDataFrame([("a", v)], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, v)], "query_id long, embedding array<double>")
    assert retrieve.knn(c, q, 1).first().distance == 0.0


def test_wrong_width_and_repeated_query_ids_raise(spark):
    c = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<double>")
    schema = "query_id long, embedding array<double>"
    with pytest.raises(ValueError, match="more than once"):
        retrieve.knn(c, spark.createDataFrame([(1, [1.0, 2.0])] * 2, schema), 1)
    with pytest.raises(ValueError, match="dimensions"):
        retrieve.knn(c, spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], schema), 1)
    with pytest.raises(Exception, match="dimensions"):
        retrieve.knn(c, spark.createDataFrame([(1, [1.0])], schema), 1).collect()


def test_report_keeps_questions_without_results(spark):
    corpus = chunk_table(spark, [("a", [0.0], {"type": "x"})])
    q = spark.createDataFrame([(1, [0.0], "x"), (2, [0.0], "none such"), (3, None, None)],
                              "query_id long, embedding array<float>, filter_type string")
    res = retrieve.retrieve(corpus, q, per_row=True, keep_unfiltered=True)
    rep = retrieve.retrieval_report(res, q).orderBy("query_id").collect()
    assert [(r.query_id, r.n_returned, r.n_kept, r.top_source) for r in rep] == [
        (1, 1, 1, "a.md"), (2, 0, 0, None), (3, 0, 0, None)]
    assert [tuple(r) for r in retrieve.retrieval_log(res).collect()] == [(1, 1, 0.0, "a.md", True)]


def test_cells_are_bounded_and_spread_over_tasks(spark, monkeypatch):
    """More questions than make up a cell of seconds form a grid even where
    they could be broadcast, and its tasks are as many as its cells."""
    monkeypatch.setattr(retrieve, "QUESTION_BLOCK_BYTES", 25 * 96)
    monkeypatch.setattr(retrieve, "SPLIT_BYTES", 20 * 96)
    rng = np.random.default_rng(9)
    rows = [(f"c{i}", rng.normal(size=4).tolist()) for i in range(100)]
    cdf = spark.createDataFrame(rows, "id string, embedding array<float>")
    qdf = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)],
                                "query_id long, embedding array<float>")
    got = retrieve.knn(cdf, qdf, 1)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.id) for r in got.collect()} == {(i, f"c{i}") for i in range(100)}
    kept, dim, blocks = retrieve._written_questions(
        qdf.select("query_id", F.col("embedding").alias("_qvec"), F.lit(1).alias("_k")), 25 * 96, 100)
    side = cdf.select(F.col("id").alias("_cid"), F.col("embedding").alias("_cvec"))
    assert blocks == 4
    assert retrieve._grid_topk(side, kept, blocks, dim, "l2sq", 0).rdd.getNumPartitions() >= 4 * 5


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e20])
def test_best_rows_of_all_kinds_of_questions(scale):
    """Filters, ties, copies, vectors that are not finite, small and large
    numbers, and k from one to all rows, against brute force."""
    rng = np.random.default_rng(11)
    rows = np.concatenate([rng.normal(size=(9000, 3)), np.ones((40, 3)),
                           rng.integers(0, 3, size=(500, 3))]) * scale
    rows[77, 1] = np.nan
    ids = np.array([f"c{i}" for i in range(len(rows))], object)
    kinds = np.array([None if i % 7 == 0 else "xy"[i % 2] for i in range(len(rows))], object)
    vec = np.concatenate([rng.normal(size=(20, 3)), np.ones((4, 3))]) * scale
    k = np.array([1, 3, 300, 0, 5000, 1 << 62] * 4)
    want = np.array([None, "", "x", "y", "x", None, "none such"] * 4, object)[:24]
    best = retrieve._Best({"pos": np.arange(24) + 100, "vec": vec, "k": k, "filters": [want]})
    found = {}
    for at in range(0, len(rows), 3000):
        part = slice(at, at + 3000)
        for pos, i, d in best.add(rows[part], ids[part], [kinds[part]]):
            for row in zip(pos, d, i):
                found.setdefault(row[0], []).append(row[1:])
    for pos, i, d in best.rest():
        for row in zip(pos, d, i):
            found.setdefault(row[0], []).append(row[1:])
    for q in range(24):
        fits = np.flatnonzero(np.isfinite(rows[:, 1]) & ((kinds == want[q]) if want[q] else True))
        true = sorted(zip(retrieve._exact_l2sq(rows, vec, fits, np.full(len(fits), q)), ids[fits]))
        assert sorted(found.get(q + 100, []))[:k[q]] == true[:k[q]]
        assert k[q] >= 5000 or len(found.get(q + 100, [])) <= k[q]
