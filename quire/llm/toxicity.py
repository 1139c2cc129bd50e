"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: case, look-alike letters of other scripts, full-width
forms, and digits or signs written for letters. The lexicon holds whole words
and word beginnings with weights learnt from labelled documents (smoothed
log-odds of document frequencies). Every word counts once, by its strongest
entry, unless an exception phrase covers it. The weights found are normalised
by the length of the text and turned into a probability by a logistic
regression of three features.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.sharing import Shared

# Labelled documents used for fitting, at most: the ones of smallest id hash.
MAX_TRAINING_ROWS = 24_000
PREFIXES = (4, 5, 6)  # lengths of the word beginnings tried as entries
MIN_DOCS = 4          # toxic documents that hold an entry, at least
MIN_GAIN = 15.0       # log-likelihood gain (G-squared) of an entry, at least
MIN_ODDS = 1.5        # its smoothed log-odds, at least
MIN_CONTEXTS = 6      # different words before an entry, at least, ...
CONTEXT_SHARE = 0.2   # ... or this share of those documents
EXCEPTION_DOCS = 3    # clean documents that hold an exception phrase, at least
RIDGE = 1.0           # of the regression, on standardised features

# Letters that look alike, and digits or signs for letters.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
    "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ո": "n", "ԛ": "q", "ԝ": "w", "в": "b",
    "к": "k", "м": "m", "н": "h", "т": "t", "ɡ": "g", "ı": "i", "ⅼ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_SIGN_IN_WORD = re.compile(r"(?<=[^\W_])[@$!|€]+(?=[^\W_])|(?<![^\W_])[@$!|€](?=[^\W_])")


class _Folding(dict):
    """Translation table that grows with the characters met: letters fold,
    everything else becomes a space."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if c in INVISIBLE:
            out = None
        elif c in LOOK_ALIKES or c in DIGITS:
            out = LOOK_ALIKES.get(c) or DIGITS[c]
        elif 0xFF41 <= code <= 0xFF5A:
            out = chr(code - 0xFF41 + ord("a"))
        else:
            out = c if c.isalpha() else " "
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Folded words with single spaces between, before and after them."""
    text = (text or "").lower()
    if any(sign in text for sign in SIGNS):
        text = _SIGN_IN_WORD.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    words = text.translate(_FOLDING).split()
    return f" {' '.join(words)} "


@dataclass
class Model:
    """Entries start with a space (word border); whole words end with one."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=lambda: [-20.0, 0.0, 0.0, 0.0])

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if not len(found):
            return None
        found.make_automaton()
        return found


def hits(automaton: ahocorasick.Automaton | None, folded: str) -> dict[int, float]:
    """Weight of each matched word, by the position of the space before it."""
    if automaton is None:
        return {}
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for start, end in excused:
        for at in [at for at in best if start <= at < end]:
            del best[at]
    return best


def features(automaton, folded: str) -> tuple[float, float, float]:
    """Total weight, weight per square root of length, and length."""
    words = max(folded.count(" ") - 1, 0)
    total = sum(hits(automaton, folded).values())
    return (math.log1p(total), total / math.sqrt(1.0 + words / 50.0), math.log1p(words))


def _probability(model: Model, x: np.ndarray) -> np.ndarray:
    z = model.coefficients[0] + x @ np.array(model.coefficients[1:])
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


# --- fitting --------------------------------------------------------------
def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS,
                  id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(text, toxic)`` of at most ``max_rows`` labelled documents outside
    the held-out fifth. A document labelled more than once counts as toxic if
    any of its labels says so; of documents that share an id the text of least
    hash is used; null ids and null labels are left out."""
    known = labels.select(F.col(id_col).alias("_id"), "toxic").filter(
        F.col("_id").isNotNull() & F.col("toxic").isNotNull()) \
        .groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.filter(~held_out(F.col("_id"))) \
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # The label side has at most ``max_rows`` rows of two numbers.
    found = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")) \
        .join(F.broadcast(chosen), "_id")
    return found.groupBy("_id").agg(F.min_by(F.struct("text", "toxic"), F.struct(
        F.xxhash64("text"), F.col("text"))).alias("r")).select("r.text", "r.toxic")


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _frame(found: list[tuple[set, int]]) -> pd.DataFrame:
    """The terms of a batch of texts, each with its text's label."""
    # Plain objects: long columns of the string type may come in several chunks.
    terms = pd.Series([t for found_in, _ in found for t in found_in], dtype=object)
    toxic = np.repeat([toxic for _, toxic in found], [len(found_in) for found_in, _ in found])
    return pd.DataFrame({"term": terms, "toxic": toxic.astype("int32")})


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        batch = []
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            found = set()
            for word in set(fold(text).split()):
                found.add(f" {word} ")
                found.update(f" {word[:n]}" for n in PREFIXES if len(word) > n)
            batch.append((found, int(toxic > 0)))
        yield _frame(batch)


def _phrases(model: Model):
    """Two-word phrases around each matched word, once for each document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for pdf in batches:
            batch = []
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                folded, found = fold(text), set()
                for at in hits(automaton, folded):
                    end = folded.index(" ", at + 1)
                    before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
                    if before >= 0:
                        found.add(folded[before:end + 1])
                    if after >= 0:
                        found.add(folded[at:after + 1])
                batch.append((found, int(toxic > 0)))
            yield _frame(batch)
    return run


def _contexts(model: Model):
    """Matched entries of toxic texts, each with the word before it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for entry in model.entries:
            automaton.add_word(entry, entry)
        automaton.make_automaton()
        for pdf in batches:
            for text in pdf["text"]:
                folded, found = fold(text), set()
                for end, entry in automaton.iter(folded):
                    at = end - len(entry) + 1
                    found.add((entry, folded[folded.rfind(" ", 0, at) + 1:at] if at else ""))
                if found:
                    yield pd.DataFrame(list(found), columns=["term", "before"], dtype=object)
    return run


def _without_copied(model: Model, toxic_rows: DataFrame, docs: dict[str, float]) -> dict:
    """Entries that stand in different contexts: words that many copies of
    one text share are no sign of toxicity."""
    seen = toxic_rows.mapInPandas(_contexts(model), "term string, before string") \
        .groupBy("term").agg(F.countDistinct("before").alias("n")).collect()  # a row per entry
    return {r.term: model.entries[r.term] for r in seen
            if r.n >= min(MIN_CONTEXTS, max(MIN_DOCS, CONTEXT_SHARE * docs[r.term]))}


def _feature_rows(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for pdf in batches:
            x = np.array([features(automaton, fold(t)) for t in pdf["text"]]).reshape(-1, 3)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2],
                                "toxic": (pdf["toxic"] > 0).astype("int32")})
    return run


def _by_term(frame: DataFrame) -> DataFrame:
    return frame.groupBy("term").agg(F.sum("toxic").cast("double").alias("a"),
                                     F.sum(1 - F.col("toxic")).cast("double").alias("b"))


def _lexicon(frame: DataFrame, n_toxic: int, n_clean: int) -> dict[str, tuple[float, float]]:
    """Weight and number of toxic documents of the strongest terms."""
    rate = n_toxic / (n_toxic + n_clean)
    n, a, b = F.col("a") + F.col("b"), F.col("a"), F.col("b")
    gain = 2 * (F.when(a > 0, a * F.log(a / (n * rate))).otherwise(0.0)
                + F.when(b > 0, b * F.log(b / (n * (1 - rate)))).otherwise(0.0))
    odds = F.log((a + 0.5) / (n_toxic + 1.0)) - F.log((b + 0.5) / (n_clean + 1.0))
    kept = _by_term(frame).filter(F.col("a") >= MIN_DOCS) \
        .select("term", "a", gain.alias("gain"), odds.alias("odds")) \
        .filter((F.col("gain") >= MIN_GAIN) & (F.col("odds") >= MIN_ODDS))
    # Terms of at most ``max_rows`` documents that several toxic ones share.
    return {r.term: (r.odds, r.a) for r in kept.collect()}


def _newton(design: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Ridge-regularised logistic regression; steps are halved until the
    penalised likelihood grows, so separable classes do no harm."""
    ridge = np.full(design.shape[1], RIDGE)
    ridge[0] = 1e-6

    def gain(beta: np.ndarray) -> float:
        z = design @ beta
        return float((y * z - np.logaddexp(0, z)).sum() - (ridge * beta * beta).sum() / 2)
    beta = np.zeros(design.shape[1])
    now = gain(beta)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -40, 40)))
        grad = design.T @ (y - p) - ridge * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        while (new := gain(beta + step)) <= now and np.abs(step).max() > 1e-9:
            step /= 2
        if new <= now + 1e-9:
            break
        beta, now = beta + step, new
    return beta


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Intercept and coefficients of the features. More weight never lowers
    a score: a weight feature that would is left out."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    used = [0, 1, 2]
    while True:
        design = np.column_stack([np.ones(len(x)), ((x - mean) / scale)[:, used]])
        beta = _newton(design, y)
        wrong = [i for i, c in zip(used, beta[1:]) if i < 2 and c < 0]
        if not wrong:
            break
        used.remove(min(wrong, key=lambda i: beta[1 + used.index(i)]))
    out = np.zeros(3)
    out[used] = beta[1:] / scale[used]
    return [float(beta[0] - out @ mean), *map(float, out)]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS,
        exceptions: tuple[str, ...] = ()) -> Model:
    """Fit on at most ``max_rows`` labelled documents (see ``training_rows``).

    ``exceptions`` are further phrases in which no word counts. Without both
    toxic and clean training documents the model finds nothing toxic.
    """
    rows = training_rows(docs, labels, max_rows).persist()
    try:
        counts = {bool(r.t): r["count"] for r in
                  rows.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
        n_toxic, n_clean = counts.get(True, 0), counts.get(False, 0)
        model = Model(exceptions=[fold(p) for p in exceptions if fold(p).strip()])
        if not n_toxic or not n_clean:
            return model
        found = _lexicon(rows.mapInPandas(_terms, "term string, toxic int"), n_toxic, n_clean)
        model.entries = {term: odds for term, (odds, _) in found.items()}
        if found:
            model.entries = _without_copied(model, rows.filter("toxic > 0"),
                                            {term: n for term, (_, n) in found.items()})
        phrases = _by_term(rows.mapInPandas(_phrases(model), "term string, toxic int"))
        excused = phrases.filter(
            (F.col("b") >= EXCEPTION_DOCS)
            & (F.col("a") * n_clean <= F.col("b") * n_toxic)).orderBy(F.desc("b"), "term")
        model.exceptions += [r.term for r in excused.collect()]
        sample = rows.mapInPandas(_feature_rows(model), "a double, b double, c double, toxic int") \
            .toPandas()  # at most max_rows rows of four numbers
        model.coefficients = _logistic(sample[["a", "b", "c"]].to_numpy(),
                                       sample["toxic"].to_numpy(float))
        return model
    finally:
        rows.unpersist()


def with_score(docs: DataFrame, model: Model, text: str = "text",
               out: str = "score") -> DataFrame:
    """Add ``out``, the probability that a text is toxic. Null and empty
    texts score as texts without words; whole texts are read."""
    shared = Shared(docs.sparkSession, model)  # entries of the bounded training rows

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        automaton = model.automaton()
        for texts in batches:
            x = np.array([features(automaton, fold(t)) for t in texts]).reshape(-1, 3)
            yield pd.Series(_probability(model, x))
    return docs.withColumn(out, score(F.col(text)))


def score_documents(docs: DataFrame, labels: DataFrame,
                    max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Per input row: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Labels of held-out documents (crc32 of the id as text, modulo 5, is 0)
    are never read. Repeated rows stay; a null id counts as empty text for
    the split; an empty table gives an empty result.
    """
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, max_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame,
               max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``docs`` without the documents predicted toxic."""
    out = "_toxicity"
    while out in docs.columns:
        out = f"_{out}"
    return with_score(docs, fit(docs, labels, max_rows), out=out) \
        .filter(F.col(out) < 0.5).select(*docs.columns)
