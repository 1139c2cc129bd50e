"""Whitening against numpy on the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), c @ u / np.sqrt(e), e / np.trace(v)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    return (rng.normal(size=(700, 12)) * np.linspace(3, 0.2, 12)).tolist()


def check(rows, vectors, ids):
    deviation, white, explained = plain(vectors)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == len(vectors) * 8 and sorted(by) == sorted(ids)
    sign = None
    for at, i in enumerate(ids):
        got = np.array([by[i][c].whitened for c in range(1, 9)])
        assert np.allclose(np.abs(got), np.abs(white[at]), atol=1e-9)
        sign = np.sign(got * white[at]) if sign is None else sign
        assert np.allclose(got * sign, white[at], atol=1e-9)  # one sign for all rows
        assert all(by[i][c].deviation == deviation[at] and by[i][c].n == len(vectors)
                   for c in by[i])
    first = by[ids[0]]
    assert np.allclose([first[c].explained for c in range(1, 9)], explained, rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error}
    assert rows[0].identity_error < 1e-9


def test_equals_numpy(spark, vectors, monkeypatch):
    # Many small blocks, several of them in each task of the product.
    monkeypatch.setattr(W, "BLOCK_CELLS", 12 * 16)
    monkeypatch.setattr(W, "BLOCKS_TOGETHER", 5)
    ids = list(range(100, 100 + len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors)), SCHEMA).repartition(4)
    check(W.whiten(df).collect(), vectors, ids)


def test_unusable_vectors_are_left_out(spark, vectors):
    ids = list(range(len(vectors)))
    bad = [(9001, None), (9002, [1.0] * 11 + [None]), (9003, [float("nan")] * 12),
           (9004, [float("inf")] + [0.0] * 11), (9005, []), (9006, [1.0, 2.0]), (9007, [1e30] * 12)]
    df = spark.createDataFrame(list(zip(ids, vectors)) + bad, SCHEMA)
    for name in ("x", "index", "id", "row", "p", "deviation"):
        df = df.withColumn(name, F.lit("clash"))
    check(W.whiten(df).collect(), vectors, ids)


def test_few_rows_and_no_variance(spark):
    empty = W.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[0] == "vec_id"
    one = W.whiten(spark.createDataFrame([(1, [0.5, 1.0])], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error)
            for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    # Repeated rows, a null id, a dimension that never changes.
    rows = [(None, [1.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 3.0])]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 8 and all((r.whitened is None) == (r.component == 2) for r in got)
    assert all(abs(r.identity_error) < 1e-12 for r in got)
    assert np.isclose([r.explained for r in got if r.component == 1], 1).all()


def test_wide_deviations_are_null_not_an_error(spark):
    rows = [(i, [float(i % 2) * 2.0 ** 39, 1.0]) for i in range(4)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 8 and all(r.deviation is None for r in got)
