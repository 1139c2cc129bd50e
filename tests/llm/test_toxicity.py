"""Toxicity: folding, matching, exceptions and held-out accuracy."""

import random

import numpy as np
import pytest

from quire.llm import toxicity as T


@pytest.mark.parametrize("text, folded", [
    (None, "  "), ("", "  "), ("An Idiot!", " an idiot "), ("1d10t", " idiot "),
    ("іdіоt", " idiot "), ("st​upid", " stupid "), ("id!ot $cum tr@sh", " idiot scum trash "),
    ("ｓｃｕｍ", " scum "), ("x&&& y$$$ z!!", " x y z ")])
def test_fold(text, folded):
    assert T.fold(text) == folded


def test_hits_count_each_word_once_and_respect_exceptions():
    model = T.Model({" idiot ": 2.0, " idi": 1.0, " scum": 3.0}, [" the idiot "])
    automaton = model.automaton()
    assert sorted(T.hits(automaton, T.fold("idiot scummy idiom")).values()) == [1.0, 2.0, 3.0]
    assert T.hits(automaton, T.fold("the idiot")) == {}
    assert T.hits(automaton, T.fold("one idiot of the idiots")) != {}
    assert T.hits(T.Model().automaton(), " x ") == {}


def corpus(seed=3, n=600):
    rng = random.Random(seed)
    bad = ["vermin", "blockhead", "nitwit"] + [f"grolv{s}" for s in ("en", "ist", "ung", "ab", "or")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("the of a sun tree river stone blue walks sleeps".split())
                 for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(1 + len(words) // 30):
                w = rng.choice(bad)
                if i % 12 == 0:
                    w = w.replace("i", "1").replace("o", "0")
                words.insert(rng.randrange(len(words)), w)
        elif i % 5 == 1:  # harmless use in a set phrase
            words[1:1] = ["garden", "vermin", "trap"]
        docs.append((i, " ".join(words), "x", None))
        labels.append((i, int(toxic)))
    return docs, labels


SCHEMA = "doc_id long, text string, score string, held_out string"


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    scored = T.score_documents(spark.createDataFrame(docs, SCHEMA),
                               spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in scored if r.held_out]
    assert len(scored) == len(docs) and 80 < len(held) < 160
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_edge_rows(spark):
    """No labels, null and empty texts, null ids, repeated rows, long text."""
    rows = [(1, None, "", ""), (2, "", "", ""), (2, "", "", ""), (None, "x", "", ""),
            (3, "nitwit " * 30_000, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in T.score_documents(docs, none).collect()] == [0] * 5
    assert T.drop_toxic(docs, none).count() == 5
    seen, labels = corpus()
    labels += [(None, 1), (3, None), (6, 1), (6, 0)]
    both = spark.createDataFrame(seen + [(1000 + i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
    kept = T.drop_toxic(both, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == both.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {1000, 1001, 1002, 1003} <= ids and 1004 not in ids and 0 not in ids
    empty = spark.createDataFrame([], SCHEMA)
    assert T.score_documents(empty, none).count() == 0


def test_regression_on_separable_classes():
    """Classes that one feature parts completely must not turn the fit round."""
    rng = np.random.default_rng(1)
    n = 4000
    toxic = rng.random(n) < 0.1
    total = np.where(toxic, rng.uniform(8, 60, n), 0.0)
    words = rng.integers(1, 2000, n)
    x = np.column_stack([np.log1p(total), total / np.sqrt(1 + words / 50), np.log1p(words)])
    beta = np.array(T._logistic(x, toxic.astype(float)))
    assert beta[1] >= 0 and beta[2] >= 0
    score = beta[0] + x @ beta[1:]
    assert ((score >= 0) == toxic).mean() > 0.999


def test_words_of_copied_texts_are_no_entries(spark):
    docs, labels = corpus()
    copy = " ".join(f"odd{chr(97 + i)}word" for i in range(20))
    for i in range(60):  # many toxic copies of one text
        docs.append((5000 + i, f"{copy} nitwit", "", ""))
        labels.append((5000 + i, 1))
    model = T.fit(spark.createDataFrame(docs, SCHEMA),
                  spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert " nitwit " in model.entries and not any("odd" in e for e in model.entries)


def test_training_rows_are_bounded(spark):
    """One id that very many documents share is trained on once."""
    docs = spark.createDataFrame([(i if i < 50 else 7, f"text {i}") for i in range(3000)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    rows = T.training_rows(docs, labels, 10)
    assert rows.count() <= 10
    every = T.training_rows(docs, labels).count()
    assert 0 < every <= 50
