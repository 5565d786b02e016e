"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and full-width forms to Latin, digits and signs that
stand for letters inside a word to those letters.  Entries of the lexicon are whole words or beginnings of words; one automaton
finds them all in one pass, and boundaries are checked at the hits only.  A hit inside an exception phrase does not count.  The
weights of the hits, as they are and per hundred words, give the score through a logistic curve.

The lexicon, the exception phrases and the curve are learned from labelled rows: at most ``max_labelled`` of them (those
with the smallest hash of doc_id), counted once per distinct text; tasks without rows or words count nothing.  Everything else covers every whole text.

Null text is empty text.  A text without hits gets the base score.  Repeated rows score alike.  Several labels of one doc_id
count as the highest.  With no labelled toxic row every score is 0.  Only doc_id and text of documents and doc_id and toxic of
labels are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ship, stored

MAX_LABELLED = 20_000
THRESHOLD = 0.3
STEM_SIZES = range(3, 10)
MIN_WEIGHT = 2.0
HELD_TERMS = 100_000

# Letters of other scripts that look like Latin ones, and digits or signs that stand for letters.
LOOKALIKES = dict(zip("аεеорсухіјѕԁһкмтвɡαβικνορτυχ", "aeeopcyxijsdhkmtbgabiknoptux"))
DIGITS = dict(zip("013457", "oieast"))
SIGNS = dict(zip("@$!|", "asil"))

_FOLD = {ord(a): b for a, b in LOOKALIKES.items()} | {c: unicodedata.normalize("NFKC", chr(c)).lower() for c in range(0xFF21, 0xFF5B) if unicodedata.normalize("NFKC", chr(c)).isalpha()}
_DIGIT = str.maketrans(DIGITS)
_ODD = re.compile("[" + "".join(LOOKALIKES) + "Ａ-ｚ]")
_SIGNED = re.compile(r"[@$!|](?<=[^\W\d_].)(?=[^\W_])")  # between a letter and a letter or digit; the sign comes first as it is rare
_NUMBERED = re.compile(r"(?<![^\W_])[^\W\d_]*+\d[^\W_]*")  # a word with a digit, entered at its start only
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """Lower case with disguised letters put right."""
    text = (text or "").lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_FOLD)
    if _SIGNED.search(text):
        text = _SIGNED.sub(lambda m: SIGNS[m.group()], text)
    return _NUMBERED.sub(lambda m: m.group() if m.group().isdecimal() else m.group().translate(_DIGIT), text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms_of(text: str) -> set[str]:
    """Whole words (``word$``) and beginnings of words of a folded text."""
    out = set()
    for w in set(_WORD.findall(text)):
        out.add(w + "$")
        out.update(w[:n] for n in STEM_SIZES if n <= len(w))
    return out


class Lexicon:
    """Weights of entries (``word$`` or a beginning of words), exception phrases and the curve; small enough for a closure."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = (), curve: tuple[float, float, float] | None = None):
        self.weights, self.exceptions, self.curve = weights, frozenset(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, entry) in a folded text; at one word the heaviest entry counts."""
        if not self.weights:
            return []
        if self._automaton is None:
            import ahocorasick
            self._automaton = ahocorasick.Automaton()
            plain: dict[str, list[str]] = {}
            for entry in self.weights:
                plain.setdefault(entry.rstrip("$"), []).append(entry)
            for word, entries in plain.items():
                self._automaton.add_word(word, (len(word), entries))
            self._automaton.make_automaton()
        best: dict[int, tuple[int, int, str]] = {}
        for last, (n, entries) in self._automaton.iter(text):
            start, end = last - n + 1, last + 1
            if start and text[start - 1].isalnum():
                continue
            whole = end == len(text) or not text[end].isalnum()
            for entry in entries:
                if (whole or entry[-1] != "$") and (start not in best or self.weights[entry] > self.weights[best[start][2]]):
                    best[start] = (start, end, entry)
        return [best[k] for k in sorted(best)]

    @staticmethod
    def phrases(text: str, start: int, end: int) -> tuple[str, str, str]:
        """The word hit, with the word before it and with the word after it."""
        while end < len(text) and text[end].isalnum():
            end += 1
        before = _WORD.findall(text[max(0, start - 60):start])[-1:]
        after = _WORD.findall(text[end:end + 60])[:1]
        word = text[start:end]
        return word, " ".join([*before, word]), " ".join([word, *after])

    def weight(self, text: str) -> tuple[float, int]:
        """Sum of the weights and number of the hits outside exception phrases."""
        total, n = 0.0, 0
        for start, end, entry in self.hits(text):
            if self.exceptions and not self.exceptions.isdisjoint(self.phrases(text, start, end)[1:]):
                continue
            total, n = total + self.weights[entry], n + 1
        return total, n

    def features(self, text: str) -> tuple[float, float, int]:
        total, n = self.weight(text)
        words = 1 + text.count(" ") + text.count("\n")
        return math.log1p(total), math.log1p(100 * total / words), n

    def score(self, a: float, b: float) -> float:
        if self.curve is None:
            return 0.0
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def choose(counts: dict[str, tuple[int, int]], positives: int, negatives: int) -> dict[str, float]:
    """Entries with a high log odds ratio; of entries that lie within each other, the one that says most, longest first."""
    least = max(4, round(0.005 * positives))
    scored = []
    for term, (p, n) in counts.items():
        weight = math.log((p + 0.5) / (positives + 1)) - math.log((n + 0.5) / (negatives + 1))
        if p >= least and weight >= MIN_WEIGHT:
            scored.append((p * weight, len(term.rstrip("$")), term, weight))
    out: dict[str, float] = {}
    words: set[str] = set()
    starts: set[str] = set()  # every beginning of the words taken
    for _, _, term, weight in sorted(scored, key=lambda x: (-round(x[0], 6), -x[1], x[2])):
        word = term.rstrip("$")
        mine = {word[:n] for n in range(1, len(word) + 1)}
        if word not in starts and words.isdisjoint(mine):
            out[term] = weight
            words.add(word)
            starts |= mine
    return out


def fit_curve(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(y)), a, b])
    w = np.zeros(3)
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """Fit on at most ``max_labelled`` labelled rows outside the held-out part."""
    ship(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_labelled rows
                   .groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic")), "labelled")
    totals = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    positives, negatives = totals.get(1, 0), totals.get(0, 0)
    if not positives:
        return Lexicon({})

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            names = list(found[0].keys() | found[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in found)], ["term", "p", "n"])
            found[0].clear()
            found[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                found[1 - toxic].update(terms_of(fold(text)))
                if len(found[0]) + len(found[1]) > HELD_TERMS:  # partial counts; Spark sums them
                    yield counted()
        if found[0] or found[1]:
            yield counted()

    least = max(4, round(0.005 * positives))
    weight = F.log((F.col("p") + 0.5) / (positives + 1)) - F.log((F.col("n") + 0.5) / (negatives + 1))
    heavy = texts.select("text", "toxic").mapInArrow(count_terms, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n")) \
        .where((F.col("p") >= least) & (weight >= MIN_WEIGHT - 1e-6))  # only terms that ``choose`` may take come to the driver
    counts = {r["term"]: (r["p"], r["n"]) for r in heavy.collect()}
    lexicon = Lexicon(choose(counts, positives, negatives))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list[str], list[int]] = ([], [])
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                text = fold(text)
                for phrase in {p for s, e, _ in lexicon.hits(text) for p in lexicon.phrases(text, s, e)[1:] if " " in p}:
                    out[0].append(phrase)
                    out[1].append(toxic)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], ["phrase", "toxic"])

    seen = texts.select("text", "toxic").mapInArrow(contexts, "phrase string, toxic int").groupBy("phrase").agg(
        F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("all"))
    clean = seen.where((F.col("all") >= 4) & (F.col("p") * 5 <= F.col("all")))  # four texts each: bounded by the labelled sample
    lexicon = Lexicon(lexicon.weights, [r["phrase"] for r in clean.collect()])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(fold(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([v[k] for v in x], pa.float64()) for k in (0, 1)), batch.column(1)], ["a", "b", "toxic"])

    rows = texts.select("text", "toxic").mapInArrow(measure, "a double, b double, toxic int").groupBy("a", "b", "toxic").count() \
        .orderBy("a", "b", "toxic").toPandas()  # at most max_labelled rows
    rows = rows.loc[rows.index.repeat(rows["count"])]
    curve = fit_curve(rows["a"].to_numpy(float), rows["b"].to_numpy(float), rows["toxic"].to_numpy(float))
    return Lexicon(lexicon.weights, lexicon.exceptions, curve)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted and n_hits for every row; columns of those names are replaced."""
    ship(docs.sparkSession)
    names = ["score", "predicted", "n_hits"]
    docs = docs.drop(*names)

    @F.pandas_udf("struct<score double, predicted int, n_hits int>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        x = [lexicon.features(fold(t)) for t in texts]
        s = [lexicon.score(a, b) for a, b, _ in x]
        return pd.DataFrame({"score": s, "predicted": [int(v >= threshold) for v in s], "n_hits": [v[2] for v in x]})

    return docs.select(F.struct("*").alias("row"), scored(F.col("text").cast("string")).alias("judged")).select("row.*", "judged.*")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score at least ``threshold``."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(*lexicon.features(fold(t))[:2]) >= threshold for t in texts], dtype=bool)

    return docs.where(~toxic(F.col("text").cast("string")))
