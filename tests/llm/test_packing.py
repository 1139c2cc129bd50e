"""Length buckets against all choices of boundaries, and batch rules."""

import itertools
import random

import numpy as np

from quire.llm import packing


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        n, k = rng.randint(1, 8), rng.randint(1, 5)
        edges = np.array(sorted(rng.sample(range(8, 200, 8), n)), float)
        counts = np.array([rng.randint(1, 9) for _ in range(n)], float)

        def padded(ends):
            return sum(c * min(e for e in ends if e >= x) for x, c in zip(edges, counts))
        got = packing.boundaries(edges, counts, k)
        best = min(padded([*some, edges[-1]]) for r in range(min(k, n))
                   for some in itertools.combinations(edges[:-1], r))
        assert len(got) <= k and got[-1] == edges[-1] and padded(got) == best
    assert packing.boundaries(np.zeros(0), np.zeros(0)) == []


def test_boundaries_of_many_lengths():
    """Against the plain recurrence, also with ties and equal counts."""
    rng = np.random.default_rng(3)
    for n, k in ((300, 7), (1000, 16), (50, 60), (1, 4)):
        edges = np.sort(rng.choice(40 * n, n, replace=False)) + 1
        counts = rng.integers(1, 50 if n != 1000 else 2, n)
        rows = np.concatenate([[0], np.cumsum(counts)])
        cost = np.concatenate([[0], edges * rows[1:]])
        for _ in range(1, min(k, n)):
            cost = np.array([0] + [min(cost[i] + edges[j - 1] * (rows[j] - rows[i])
                                       for i in range(j)) for j in range(1, n + 1)])
        ends = packing.boundaries(edges, counts, k)
        padded = sum(int(c) * min(e for e in ends if e >= x) for x, c in zip(edges, counts))
        assert len(ends) <= k and padded == cost[n]


def test_a_million_lengths_take_seconds():
    import time

    t = time.time()
    ends = packing.boundaries(np.arange(1, 1_000_001), np.ones(1_000_000, int), 8)
    assert len(ends) == 8 and ends[-1] == 1_000_000 and time.time() - t < 60


def test_shared_ids_are_spread(spark):
    """Rows of one id, or of none, are numbered in all blocks."""
    from quire.llm.ranking import gapless

    rows = [(None, 1, i) for i in range(500)] + [(5, 1, 500 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g int, row long")
    got = gapless(df, "g", ["id"], blocks=16, row="row").collect()
    assert sorted(r.slot for r in got) == list(range(1000))
    assert len({r.slot // 100 for r in got if r.id is None}) == 10


def check(rows, budget, buckets):
    assert len({r.bucket for r in rows}) <= buckets
    for bucket in {r.bucket for r in rows}:
        own = [r for r in rows if r.bucket == bucket]
        (padded,) = {r.padded for r in own}
        assert all(0 <= r.n_tokens <= padded and r.padding == padded - r.n_tokens for r in own)
        size = max(budget // padded, 1)
        places = sorted((r.batch, r.slot) for r in own)
        assert places == [(i // size, i % size) for i in range(len(own))]


def test_pack(spark):
    """Nulls, empty and long texts, repeated rows, a hot length, clashes."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([3, 3, 3, rng.randint(1, 400)]), "x") for i in range(500)]
    rows += [(None, "a b", "x"), (None, None, "x"), (7, "", None), (7, "", None),
             (8, "long, " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = packing.pack(docs, buckets=5, batch_tokens=2048).collect()
    assert len(got) == len(rows)
    check(got, 2048, 5)
    lengths = sorted(r.n_tokens for r in got)
    assert lengths[:3] == [0, 0, 0] and lengths[-1] == 100_000
    assert packing.pack(docs.filter("false")).count() == 0


def test_few_lengths_need_no_padding(spark):
    docs = spark.createDataFrame([(i, "w " * (9 + 3 * (i % 16))) for i in range(200)],
                                 "doc_id long, text string")
    got = packing.pack(docs, buckets=16).collect()
    assert all(r.padding == 0 and r.padded == r.n_tokens for r in got)
