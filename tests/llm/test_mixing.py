"""Mixes against their targets, a plain water-filling and a plain sample."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing as M


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; what is above ``most`` sizes is shared out again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: share.get(s, most * sizes[s]) for s in order}
        capped |= above


def docs_of(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def corpus():
    rows, at = [], 0
    for source, n in (("b", 900), ("a", 300), (None, 200), ("é", 40), ("Z", 5), ("empty", 2)):
        for _ in range(n):
            words = (at * 7919) % 61 + (3000 if at % 97 == 0 else 0)
            rows.append((at, "w " * (0 if source == "empty" else words), source))
            at += 1
    return rows


def sums(rows):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    return sizes, taken, target


def test_targets_and_taken(spark, corpus):
    got = M.mix(docs_of(spark, corpus)).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in corpus]
    by = {r.doc_id: r for r in got}
    assert all(by[i]["size"] == len(t.split()) for i, t, _ in corpus)
    sizes, taken, target = sums(got)
    assert all(r.source_size == sizes[r.source] for r in got)
    want = plain_targets(dict(sizes))
    for s in want:
        assert math.isclose(target[s], want[s], rel_tol=1e-12, abs_tol=1e-9)
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 2
    # Copies of one source differ by one at most.
    for s in want:
        copies = {r.copies for r in got if r.source == s and r["size"]}
        assert not copies or max(copies) - min(copies) <= 1


def test_reruns_and_partitions_agree(spark, corpus, monkeypatch):
    docs = docs_of(spark, corpus)
    first = {r.doc_id: r.copies for r in M.mix(docs).collect()}
    monkeypatch.setattr(M, "ROWS_PER_BLOCK", 7)  # many blocks in a source
    again = {r.doc_id: r.copies for r in M.mix(docs.repartition(11)).collect()}
    assert first == again
    other = {r.doc_id: r.copies for r in M.mix(docs, seed="mix-2").collect()}
    assert first != other


def test_inclusion_follows_importance(spark):
    """Documents of double importance are sampled twice as often."""
    rows = [(i, "w " * 20, "a") for i in range(400)] + [(1000 + i, "w " * 20, "b") for i in range(400)]
    docs = docs_of(spark, rows)
    odds = F.when(F.col("doc_id") % 4 == 0, 2.0).when(F.col("doc_id") % 4 == 1, 0.0).otherwise(1.0)
    hits = defaultdict(int)
    for seed in ("s1", "s2", "s3"):
        for r in M.mix(docs, importance=odds, seed=seed, weights=(1, 7)).collect():
            if r.source == "a":
                hits[r.doc_id % 4] += r.copies
    # Source a keeps a quarter of its words: 0.25 * (2, 0, 1, 1) copies.
    assert hits[1] == 0 and sum(hits.values()) == 300
    assert abs(hits[0] - 150) < 40 and abs(hits[2] - 75) < 35 and abs(hits[3] - 75) < 35


def test_pareto_rank(spark):
    df = spark.createDataFrame([(0.3, 0.5), (0.3, 0.9), (0.3, 1.0), (0.3, 0.0)], "u double, p double")
    got = [r.r for r in df.select(M.pareto_rank(F.col("u"), F.col("p")).alias("r")).collect()]
    odds = (0.3 / 0.7) / (0.5 / 0.5), (0.3 / 0.7) / (0.9 / 0.1)
    assert math.isclose(got[0] / (1 - got[0]), odds[0]) and math.isclose(got[1] / (1 - got[1]), odds[1])
    assert got[2] == 0 and got[3] == 1


def test_equal_rows_are_split_at_the_edge(spark):
    """One document many times: the sample takes part of its rows."""
    rows = [(None, "a b c d", "x")] * 500 + [(1, "e f", "y")] * 3
    got = M.mix(docs_of(spark, rows).repartition(6), weights=(1, 1)).collect()
    assert len(got) == 503
    sizes, taken, target = sums(got)
    assert sizes == {"x": 2000, "y": 6} and target["y"] == 18 and taken["y"] == 18
    assert abs(taken["x"] - target["x"]) <= 2
    assert {r.copies for r in got if r.source == "x"} == {0, 1}


def test_edges(spark):
    rows = [(1, None, "a", 5), (None, "", None, 6), (2, "one two", "a", 7), (2, "three", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int") \
        .withColumn("size", F.lit(1)).withColumn("at", F.lit("x")).withColumn("rank", F.lit(0))
    got = M.mix(docs).collect()
    assert sorted((r["size"], r.source or "-") for r in got) == [(0, "-"), (0, "a"), (1, "-"), (2, "a")]
    sums(got)
    none = docs_of(spark, [])
    assert M.mix(none).count() == 0
    blank = M.mix(docs_of(spark, [(1, "", "a"), (2, None, "b")])).collect()
    assert [(r["size"], r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2
    long = M.mix(docs_of(spark, [(1, "w " * 400_000, "a"), (2, "x", "a")])).collect()
    assert sorted(r["size"] for r in long) == [1, 400_000]
