"""Benchmark passages against a brute-force alignment."""

import random

import numpy as np

from quire.llm import decontam as D


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            same = a[i] == b[j] and a[i] >= 0
            h[i + 1, j + 1] = max(0, h[i, j] + (D.MATCH if same else D.MISMATCH),
                                  h[i, j + 1] + D.GAP, h[i + 1, j] + D.GAP)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = (rng.integers(-1, 4, rng.integers(1, 25)) for _ in range(2))
        score, start, end = D.align(a, b)
        assert score == plain_alignment(a, b)
        if score:  # the span alone gives the score
            assert plain_alignment(a, b[start:end]) == score


def make(seed=1):
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(3000)]
    common = "the of and in to is".split()

    def words(n):
        return [rng.choice(common) if rng.random() < .4 else rng.choice(rare) for _ in range(n)]
    items = [(i, " ".join(words(rng.randint(12, 50)))) for i in range(30)]
    items += [(90, None), (91, ""), (92, "two words"), (3, items[3][1])]
    docs, planted = [], set()
    for d in range(300):
        body = words(rng.randint(0, 200))
        if d % 5 == 0:
            i = rng.randrange(30)
            part = items[i][1].split()
            for _ in range(len(part) // 8 if d % 10 else 0):  # edited copies
                k = rng.randrange(len(part))
                part[k:k + 1] = rng.choice([[], ["changed"], [part[k], "more"]])
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() if d % 3 else w for w in part]
            planted.add((d, i))
        docs.append((d, " ".join(body), 0))
    # One item copied into very many documents keeps seeds.
    docs += [(1000 + d, "start " + items[7][1] + " end", 0) for d in range(400)]
    planted |= {(1000 + d, 7) for d in range(400)}
    return docs, items, planted


def brute(docs, items):
    """Every item against every document."""
    out = set()
    for i, text in items:
        a = D.words_of(text)
        if not a:
            continue
        known = {w: k for k, w in enumerate(a)}
        x = np.array([known[w] for w in a])
        for d, body, _ in docs:
            y = np.array([known.get(w, -1) for w in D.words_of(body)], int)
            if len(y) and D.align(x, y)[0] >= D.THRESHOLD * D.MATCH * len(x):
                out.add((d, i))
    return out


def test_finds_what_brute_force_finds(spark):
    docs, items, planted = make()
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_passages(d, b).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    small = [x for x in docs if x[0] < 1100]
    want = {p for p in brute(small, items) if p[1] != 92}
    assert planted <= got
    assert {p for p in got if p[0] < 1100 and p[1] != 92} == want
    texts = {x[0]: x[1] for x in docs}
    whole = next(r for r in rows if r.doc_id == 1000)
    assert texts[1000][whole.start:whole.end] == items[7][1]
    # The same in many blocks of the benchmark.
    few = d.filter("doc_id < 100")
    blocks = list(D.matchers(few, b, block_bytes=2000))
    assert len(blocks) >= 3
    assert {(r.doc_id, i) for m in blocks for r in few.collect() for i, *_ in m.spans(r.text)} \
        >= {p for p in planted if p[0] < 100}


def test_edge_rows(spark):
    """Null and empty texts, null ids, repeated rows, long texts, no tables."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    schema = "doc_id long, text string, score string, item_id string"
    docs = spark.createDataFrame([
        (1, None, "", ""), (2, "", "", ""), (None, f"x {item} y", "", ""), (3, item, "", ""),
        (3, item, "", ""), (4, "nothing here", "", ""),
        (5, "filler " * 50_000 + item.upper(), "", "")], schema)
    items = spark.createDataFrame([(7, item, 1), (8, None, 1)],
                                  "item_id long, text string, doc_id long")
    found = D.find_passages(docs, items)
    assert sorted((str(r.doc_id), r.item_id, r.score) for r in found.collect()) == [
        ("3", 7, 1.0), ("3", 7, 1.0), ("5", 7, 1.0), ("None", 7, 1.0)]
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    none = items.filter("false")
    assert D.find_passages(docs, none).count() == 0
    assert D.drop_contaminated(docs, none).count() == 7
    assert D.find_passages(docs.filter("false"), items).count() == 0


def spread(words, step, edit):
    """``words`` with every ``step``-th one edited."""
    out = []
    for k, w in enumerate(words):
        out += [w] if (k + 1) % step else edit(w, k)
    return out


EDITS = [lambda w, k: [w, f"in{k}"], lambda w, k: [f"re{k}"], lambda w, k: []]


def test_evenly_spread_edits(spark):
    """All alignments of the threshold are found, without any short item."""
    rng = random.Random(4)
    rare = [f"w{i}" for i in range(2000)]
    common = "the of and in to is".split()
    items = [(i, " ".join(rng.choice(common if rng.random() < .5 else rare) for _ in range(m)))
             for i, m in enumerate([3, 4, 5, 7, 10, 16, 25, 39, 59, 120] * 2)]
    texts = [" ".join(["start"] * (step - 1) + spread(text.split(), step, edit) + ["end"])
             for _, text in items for step in (1, 2, 3, 4, 5) for edit in EDITS]
    docs = [(d, text, 0) for d, text in enumerate(texts)]
    docs += [(1000 + d, " ".join(rng.choice(common if rng.random() < .5 else rare)
                                 for _ in range(100)), 0) for d in range(100)]
    want = brute(docs, items)
    assert len(want) > 200
    rows = D.find_passages(spark.createDataFrame(docs, "doc_id long, text string, x int"),
                           spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want == {(r.doc_id, r.item_id) for r in rows if r.score >= D.THRESHOLD}


def test_excerpts_of_long_items(spark):
    """A leaked passage counts by its own length, however long the item is."""
    rng = random.Random(6)
    rare = [f"w{i}" for i in range(2000)]
    common = "the of and in to is".split()

    def words(n):
        return [rng.choice(common if rng.random() < .5 else rare) for _ in range(n)]
    items = {i: words(m) for i, m in enumerate([59, 410, 1500])}
    docs, want = [], set()
    for i, item in items.items():
        cuts = [(n, lo) for n in (13, 14, 20, 28) for lo in range(0, len(item) - n, 7)]
        if len(item) > 400:
            cuts += [(200, 0), (200, 200)]
        for n, lo in cuts:
            want.add((len(docs), i))
            docs.append(words(30) + item[lo:lo + n] + words(30))
        for edit in EDITS:  # two changes among 19 words
            for lo in range(0, len(item) - 19, 5):
                want.add((len(docs), i))
                docs.append(words(30) + spread(item[lo:lo + 18], 7, edit) + item[lo + 18:lo + 19])
        for lo in range(0, len(item) - 10, 9):
            docs.append(["start"] * 3 + item[lo:lo + 10] + ["end"])
    table = spark.createDataFrame([(d, " ".join(x), 0) for d, x in enumerate(docs)],
                                  "doc_id long, text string, x int")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()],
                                  "item_id long, text string")
    rows = D.find_passages(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    kept = D.drop_contaminated(table, bench)
    assert kept.count() == len(docs) - len(want)


def test_short_items_change_no_other(spark):
    """Items of one or two words, alone or in a block with others."""
    docs, items, _ = make(3)
    docs = docs[:200] + [(2000, "a lonely word", 0), (2001, "two x words", 0),
                         (2002, "words two", 0)]
    short = [(93, "lonely"), (94, "two words")]
    long = [x for x in items if x[0] < 90]
    d = spark.createDataFrame(docs, "doc_id long, text string, x int")

    def found(rows):
        b = spark.createDataFrame(rows, "item_id long, text string")
        return {tuple(r) for r in D.find_passages(d, b).collect()}
    together = found(long + short)
    assert {x for x in together if x[1] < 90} == found(long)
    assert {x[:2] for x in together if x[1] > 90} == {(2000, 93), (2001, 94)}
