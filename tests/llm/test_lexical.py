"""Ranked search against a plain evaluation, and the sharing graph."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_all = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 50 + (50 * n * n_docs) // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(plain_terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return out


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Über", "éa", "THE", "the", "don't", "x_y", "日本"]
    docs = [(i, " ".join(rng.choice(words[:rng.choice([10, 60, 127])])
                         for _ in range(rng.randint(0, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(30)]
    return docs, items


def run(spark, docs, items, top=10, **options):
    got = X.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                   spark.createDataFrame(items, "item_id long, text string"), top, **options)
    return sorted(map(tuple, got.collect()), key=str)


def test_terms():
    for text in ["A-b_c d9", "Éclair ÀB x", "", None, "\u0080y", "a\x00b\x7fc"]:
        assert [t.decode() for t in X.terms(text and text.encode())] == plain_terms(text)


def test_equals_brute_force(spark):
    docs, items = corpus()
    want = sorted(brute(docs, items, 10), key=str)
    assert run(spark, docs, items) == want
    # Blocks of items, and no mining of pairs: the same rows.
    assert run(spark, docs, items, block_bytes=300) == want


def test_graph_sums_every_item():
    rng = random.Random(4)
    pool = [rng.sample(range(60), 12) for _ in range(5)]
    items = [rng.choice(pool)[:rng.randint(4, 12)] + rng.sample(range(60, 80), 3) for _ in range(40)]
    items.append([])
    for mined in (4096, 10, 0):
        graph = X.sharing_graph(items, 80, mined)
        evaluate = X.Evaluator(graph, np.ones(80, np.int64), 10, 100)
        n = np.full(6, 10)
        row, term = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(80), indexing="ij"))
        tf = np.array([rng.randint(0, 9) for _ in term])
        got = evaluate(n, row, term, tf)
        m = 50 + 50 * 10 * 10 // 100
        impact = ((10**9 * tf) // (1000 * tf + 20 * m)).reshape(6, 80)
        for at, i in enumerate(evaluate.scored):
            assert (got[at] == impact[:, sorted(set(items[i]))].sum(axis=1)).all()
        assert 40 not in evaluate.scored
    plain = sum(max(len(set(i)) - 1, 0) for i in items)
    assert X.sharing_graph(items, 80).additions() < plain / 2


def test_ties_nulls_and_repeats(spark):
    docs = [(5, "a b"), (3, "a b"), (None, "a b"), (3, "a b"), (4, None), (6, ""), (7, "c " * 200_000),
            (8, "?!")]
    items = [(1, "A"), (1, "a"), (None, "b zzz"), (2, None), (3, ""), (4, "c"), (5, "zzz")]
    got = run(spark, docs, items, top=3)
    assert got == sorted(brute(docs, items, 3), key=str)
    assert [r[2] for r in got if r[0] is None] == [3, 3, 5]
    assert len(got) == 10


def test_empty_tables_and_clashing_names(spark):
    docs, items = corpus(40)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == []
    assert run(spark, [(1, None)], items) == []
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    for name in ("item", "at", "n", "score", "rank", "terms"):
        d, i = d.withColumn(name, F.lit("x")), i.withColumn(name, F.lit(1))
    got = X.search(d, i, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, items, 10), key=str)
