"""SimHash near-duplicates against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import components, simhash


def plain_fingerprint(text, shingle=4):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", out) if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(len(words) - shingle + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c d", "A a A a A a",
                                  "Überall ÄÖ x\x0bY z\x1cw É é", "w " * 50_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_agrees(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()
    assert np.int64(row[0]).view(np.uint64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_golay_covers():
    golay = simhash.GolayAnchors()
    x = np.random.default_rng(1).integers(0, 1 << 23, 500)
    row, anchor = golay(x)
    d = np.bitwise_count(x[row] ^ anchor)
    assert d.max() <= simhash.GOLAY_RADIUS + 1
    # Exactly one home, and every anchor within radius + 1 is met.
    assert (np.bincount(row, d <= simhash.GOLAY_RADIUS) == 1).all()
    codewords = {int(a) for a in golay(np.arange(1 << 12))[1]}
    assert all(bin(a ^ b).count("1") >= 7 for a, b in itertools.combinations(
        random.Random(2).sample(sorted(codewords), 60), 2))


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 5, 9])
def test_blocks_cover_every_pair(bits):
    rng = random.Random(bits)
    blocks = simhash.bit_blocks(bits)
    assert sum(2 if c else 1 for *_, c in blocks) == bits + 1
    for _ in range(200):
        diff = sum(1 << b for b in rng.sample(range(64), bits))
        assert any(bin(diff >> s & (1 << w) - 1).count("1") <= int(c) for s, w, c in blocks)


def brute(fps, ids, bits):
    label = {f: min(i for i, g in zip(ids, fps) if g == f and i is not None) for f in set(fps)}
    while True:
        new = {f: min(label[g] for g in label if bin(f ^ g).count("1") <= bits) for f in label}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("split_above", [simhash.SPLIT_ABOVE, 3])
def test_near_links_join_what_brute_force_joins(spark, split_above):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base[:20]:  # chains and dense groups
        for _ in range(rng.randint(1, 12)):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(f)
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges = simhash.near_links(frame, 4, split_above)
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    want = brute(fps, fps, 4)
    label = {}
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        label.setdefault(want[f], set()).add(got.get(s, s))
    assert all(len(v) == 1 for v in label.values())
    assert len({next(iter(v)) for v in label.values()}) == len(set(want.values()))
    for u, v, in edges.select("u", "v").collect():
        assert bin((u ^ v) & (1 << 64) - 1).count("1") <= 4


SCHEMA = "doc_id long, text string, fp string, component_id string, node long"
ROWS = [(1, "a b c d e f g", "x", "y", 0), (2, "A b\tc d  e f g", None, None, None),
        (3, None, "", "", 1), (4, "", "", "", 1), (5, "  \n", "", "", 1), (5, "  \n", "", "", 1),
        (None, "a b c d e f g", "", "", 1), (6, "only two", "", "", 1),
        (7, "word " * 60_000, "", "", 1)]


def test_edge_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted(map(tuple, simhash.simhash_components(docs).select(
        "doc_id", "component_id", simhash.hex_fingerprint(F.col("fp"))).collect()), key=str)
    fps = [plain_fingerprint(r[1]) for r in ROWS]
    label = brute(fps, [r[0] for r in ROWS], 4)
    assert got == sorted(((r[0], label[f], f"{f:016x}") for r, f in zip(ROWS, fps)), key=str)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "3", "6", "7"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 3), (None, 1), (3, 5)]
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    assert got == {3: 3, 5: 3} | {i: 100 for i in range(100, 161)}


def test_every_component_keeps_one_row(spark):
    """Repeated and null ids: no text goes with another one's copy."""
    a, b, c, d = ("the quick brown fox number %d runs over many lazy dogs %d" % (i, i * i)
                  for i in (1, 20, 300, 4000))
    rows = [(1, a), (2, a), (2, b), (3, c), (5, c), (5, d), (None, d + " end"), (None, a), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "_row", F.lit("clash"))
    parts = simhash.simhash_components(docs)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    texts = [r.text for r in got.collect()]
    fps = {t: simhash.fingerprint(t) for _, t in rows}
    assert len(texts) == len({fps[t] for t in texts})
    near = lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 4
    assert all(any(near(t, kept) for kept in texts) for _, t in rows)
    assert {(r.doc_id, r.text) for r in got.collect()} >= {(1, a), (2, b), (3, c)}
    assert parts.count() == len(rows)
