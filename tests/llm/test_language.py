import random
import zlib

import numpy as np

from sluice.llm import language
from tests.llm.helpers import LONG_TEXT, clashing, docs_of

PARTS = {"en": "the and ing tion er on at", "de": "der und ung keit sch ein ver", "fr": "que les eau ment oir ré tre"}


def corpus(rnd, n):
    return [(i, " ".join("".join(rnd.choice(PARTS[lang].split()) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 60))), lang)
            for i, lang in enumerate(rnd.choice(list(PARTS)) for _ in range(n))]


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(0), 600)
    docs = docs_of(spark, rows)
    model = language.learn(docs, per_language=80)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 100 and sum(got[d].lang_pred == lang for d, _, lang in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert model.centroids.shape == (3 * language.CLUSTERS, language.DIMENSIONS)


def test_labels_are_no_input(spark):
    rows = corpus(random.Random(1), 200)
    docs = docs_of(spark, rows)
    model = language.learn(docs)
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    two = {r.doc_id - 5000: (r.lang_pred, r.score) for r in language.predict(docs_of(spark, [(d + 5000, t, "xx") for d, t, _ in rows]).repartition(3), model).collect()}
    assert one == two


def test_held_out_rows_train_nothing(spark):
    rows = corpus(random.Random(2), 200)
    changed = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 4 == 2 else lang) for d, t, lang in rows]
    assert set(language.learn(docs_of(spark, changed)).langs) == set(PARTS)


def test_awkward_rows(spark):
    rows = corpus(random.Random(3), 120)
    odd = [(1001, None, "en"), (1002, "", None), (1003, "123 !?", "en"), (1004, LONG_TEXT, None), (None, "the and ing", None), (1005, "x", None), (1005, "x", None)]
    docs = clashing(docs_of(spark, rows + odd))
    got = {r.doc_id: r for r in language.predict(docs, language.learn(docs)).collect()}
    assert len(got) == 120 + 6
    for d in (1001, 1002, 1003):
        assert (got[d].lang_pred, got[d].score, got[d].rejected) == ("und", 0.0, False)
    assert all(got[d].lang_pred in PARTS for d in (1004, 1005, None))


def test_nothing_to_learn_from(spark):
    docs = docs_of(spark, [(0, "the and", None)])
    assert [r.lang_pred for r in language.predict(docs, language.learn(docs)).collect()] == ["und"]
    assert language.predict(docs_of(spark, []), language.learn(docs_of(spark, []))).count() == 0


def test_far_texts_are_rejected(spark):
    docs = docs_of(spark, corpus(random.Random(4), 300))
    got = language.predict(docs_of(spark, [(1, "zzzz qqqq xxxx jjjj zzzz")]), language.learn(docs)).first()
    assert got.rejected


def test_clusters_are_unit_vectors():
    x = np.random.default_rng(0).random((50, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, far = language.cluster(x, 3)
    assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5) and len(far) == 3


def test_a_language_without_letters(spark):
    """It gets no centroid; the others are learned and every row is answered."""
    rows = corpus(random.Random(6), 120)
    odd = [(d, t, "xx") for d, t in zip(range(2000, 2040), ["12345 67", None, "", "... !"] * 10)]
    model = language.learn(docs_of(spark, rows + odd))
    assert set(model.langs) == set(PARTS)
    got = {r.doc_id: r.lang_pred for r in language.predict(docs_of(spark, rows + odd), model).collect()}
    assert all(got[d] == "und" for d, _, _ in odd) and len(got) == 160
    only = language.learn(docs_of(spark, odd))
    assert only.langs == [] and {r.lang_pred for r in language.predict(docs_of(spark, odd + [(1, "abc", None)]), only).collect()} == {"und"}


def test_languages_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = docs_of(spark, corpus(random.Random(7), 120))
    one = language.learn(docs)
    monkeypatch.setattr(language, "BROADCAST_LANGUAGES", 0)
    two = language.learn(docs)
    assert one.langs == two.langs and np.array_equal(one.centroids, two.centroids)


def test_centroid_and_cosine_by_hand(spark):
    """One language of one text: its centroid is the text's normalised TF-IDF vector, and the cosine follows from the counts."""
    rows = [(d, "abc abc", "l") for d in range(8)] + [(d, "xyz", "m") for d in range(8, 16)]
    model = language.learn(docs_of(spark, rows))
    x = np.log1p(language.counts("abc abc")) * model.idf
    mine = model.centroids[[k for k, v in enumerate(model.langs) if v == "l"]]
    assert np.allclose(mine, x / np.linalg.norm(x), atol=1e-6)
    q = np.log1p(language.counts("abc q")) * model.idf
    cosine = [float(q @ c / np.linalg.norm(q)) for c in model.centroids]
    best = {v: max(c for c, w in zip(cosine, model.langs) if w == v) for v in ("l", "m")}
    odds = {v: np.exp(c / language.TEMPERATURE) for v, c in best.items()}
    got = language.predict(docs_of(spark, [(1, "abc q")]), model).first()
    assert got.lang_pred == "l" and abs(got.score - odds["l"] / sum(odds.values())) < 1e-5
