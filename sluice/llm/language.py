"""Language identification by nearest centroid.

A text becomes a vector of letter n-grams (one to three letters of the lower-cased text, anything between words one blank),
hashed to ``DIMENSIONS`` places, weighted by TF-IDF and normalised.  Every language has several centroids, found by spherical
k-means, and a text takes the language of the centroid with the highest cosine; at equal cosine the language that sorts first.
A text farther from its centroid than nearly all of the texts it was made from is marked ``rejected``.

Document frequencies are counted over all training rows.  The centroids are fitted on at most ``per_language`` documents of
each language (those with the smallest hash of doc_id), each language in a task of its own.  A language none of whose sampled
texts has a letter gets no centroid.

Null text and text without a letter: "und", score 0, not rejected.  Without training rows everything is "und".  Rows with null
lang train nothing.  Repeated rows get equal answers.  Only doc_id, text and, for training, lang are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ship, stored

DIMENSIONS = 1 << 12
PER_LANGUAGE = 600
BROADCAST_LANGUAGES = 100_000
CLUSTERS = 4
ROUNDS = 12
FAR_QUANTILE = 0.01
TEMPERATURE = 0.05
BLOCK = 128  # rows vectorised together
_LETTER: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts; None for a text without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32)
    codes = codes[np.concatenate(([True], is_letter[1:] | is_letter[:-1]))].astype(np.uint64)  # runs of others are one blank
    codes = np.concatenate(([np.uint64(32)], codes, [np.uint64(32)]))
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    value = np.zeros(len(codes), dtype=np.uint64)
    for n in range(3):
        if n >= len(codes):
            break
        value = value[:len(codes) - n] * np.uint64(0x100000001B3) + codes[n:] + np.uint64(1)
        place = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        out += np.bincount(place.astype(np.int64), minlength=DIMENSIONS)
    return out


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which texts have letters, their normalised TF-IDF rows)."""
    have, rows = np.zeros(len(texts), dtype=bool), []
    for i, text in enumerate(texts):
        c = counts(text)
        if c is not None:
            have[i] = True
            rows.append(np.log1p(c).astype(np.float32) * idf)
    x = np.array(rows, dtype=np.float32).reshape(-1, DIMENSIONS)
    return have, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts: (centroids, cosine that all but a few members reach)."""
    starts = [0]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin((x @ x[starts].T).max(axis=1))))
    c = x[starts].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                mean = x[own == j].mean(axis=0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    cosine = x @ c.T
    own = np.argmax(cosine, axis=1)
    far = [float(np.quantile(cosine[own == j, j], FAR_QUANTILE)) if (own == j).any() else -1.0 for j in range(len(c))]
    return c, np.array(far)


class Model:
    """Centroids by language, in the order of the languages' names."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, far: np.ndarray):
        self.idf, self.langs, self.centroids, self.far = idf, langs, centroids, far

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        have, x = vectors(texts, self.idf)
        langs, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        if not self.langs or not have.any():
            return langs, scores, rejected
        cosine = x @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        names = sorted(set(self.langs))
        by_lang = np.stack([cosine[:, [k for k, v in enumerate(self.langs) if v == n]].max(axis=1) for n in names], axis=1)
        odds = np.exp((by_lang - by_lang.max(axis=1, keepdims=True)) / TEMPERATURE)
        for row, i in enumerate(np.flatnonzero(have)):
            langs[i] = self.langs[best[row]]
            scores[i] = odds[row].max() / odds[row].sum()
            rejected[i] = cosine[row, best[row]] < self.far[best[row]]
        return langs, scores, rejected


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows of ``docs`` (doc_id, text, lang) outside the held-out part."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                c = counts(text.as_py())
                if c is not None:
                    df += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(np.append(df, n))], ["place", "df"])

    total = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    summed = rows.select("text").mapInArrow(frequencies, "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))
    for r in summed.collect():  # DIMENSIONS + 1 rows
        total[r["place"]] = r["df"]
    idf = np.log((1 + total[-1]) / (1 + total[:-1])).astype(np.float32) + np.float32(1)

    often = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    if often.count() <= BROADCAST_LANGUAGES:  # else a plain join, whose hot languages are split at run time
        often = F.broadcast(often)
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n"))  # twice the bound, of which the task takes the smallest
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = rows.join(often, "lang").where(place < share * (1 << 30)).select("lang", "text", place.alias("place"))

    def centroids(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["place", "text"]).head(per_language)
        _, x = vectors(part["text"].tolist(), idf)
        if not len(x):
            return pd.DataFrame({"lang": pd.Series(dtype=object), "centroid": pd.Series(dtype=object), "far": pd.Series(dtype=float)})
        c, far = cluster(x)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centroid": [row.tobytes() for row in c], "far": far})

    fitted = stored(sample.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, far double"), "centroids") \
        .orderBy("lang", "centroid").collect()  # CLUSTERS rows for each language
    return Model(idf, [r["lang"] for r in fitted], np.array([np.frombuffer(r["centroid"], np.float32) for r in fitted]).reshape(-1, DIMENSIONS),
                 np.array([r["far"] for r in fitted]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = [], [], []
            for lo in range(0, batch.num_rows, BLOCK):
                one = model.predict(batch.column(1).slice(lo, BLOCK).to_pylist())
                langs += one[0]
                scores += one[1].tolist()
                rejected += one[2].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")
