import random
import zlib

from sluice.llm import toxicity
from tests.llm.helpers import LONG_TEXT, clashing, docs_of

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grumbler", "snarfle", "blighty"]


def corpus(rnd, n):
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice(["an", "er", "on", "ti", "re"]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(20, 80))]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        if i % 29 == 1:
            words.append("grumbler fish")  # a harmless phrase
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_rows(spark):
    rows, labels = corpus(random.Random(0), 500)
    docs = docs_of(spark, rows)
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, LABELS))
    assert {e.rstrip("$")[:6] for e in lexicon.weights} >= {b[:6] for b in BAD}
    assert "grumbler fish" in lexicon.exceptions
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    held = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    right = sum(got[d].predicted == int(d % 5 == 0) for d in held)
    assert len(held) > 80 and right >= 0.98 * len(held)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, lexicon).collect()}
    assert kept == {d for d, r in got.items() if r.predicted == 0}


def test_folding():
    assert toxicity.fold("1D10T сlоwn SNＡRFLE b@d 2024 c1own") == "idiot clown snarfle bad 2024 ciown"
    assert toxicity.fold(None) == ""


def test_matches_at_word_starts_only():
    lexicon = toxicity.Lexicon({"clown$": 3.0, "idio": 2.0}, ["sad clown"])
    assert [h[2] for h in lexicon.hits(toxicity.fold("clowns clown, idiotic xidiot CL0WN"))] == ["clown$", "idio", "clown$"]
    assert lexicon.weight("the sad clown") == (0.0, 0) and lexicon.weight("a clown") == (3.0, 1)


def test_length_matters():
    lexicon = toxicity.Lexicon({"clown$": 3.0}, curve=(-4.0, 0.5, 1.0))
    short, long = (lexicon.score(*lexicon.features(t)[:2]) for t in ("clown", "clown " + "word " * 500))
    assert short > long > lexicon.score(*lexicon.features("")[:2])


def test_awkward_rows(spark):
    rows, labels = corpus(random.Random(1), 300)
    odd = [(1001, None), (1002, ""), (1003, LONG_TEXT), (None, "snarfle snarfle snarfle"), (1004, "x"), (1004, "x")]
    marks = labels + [(1001, 1, 1), (1002, None, None), (None, 1, 1), (0, 1, 0), (9999, 0, 1)]
    docs = clashing(docs_of(spark, rows + odd))
    lexicon = toxicity.learn(docs, spark.createDataFrame(marks, LABELS))
    out = toxicity.score(docs, lexicon)
    got = out.collect()
    assert len(got) == 306 and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert all(r.predicted == 0 for r in got if r.doc_id in (1001, 1002, 1003, 1004))
    assert toxicity.drop_toxic(docs, lexicon).columns == docs.columns


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], LABELS)
    lexicon = toxicity.learn(docs_of(spark, [(1, "a")]), none)
    assert [(r.score, r.predicted) for r in toxicity.score(docs_of(spark, [(1, "a")]), lexicon).collect()] == [(0.0, 0)]
    assert toxicity.score(docs_of(spark, []), lexicon).count() == 0


def test_rare_toxic_words_among_many_common_ones(spark):
    common = " ".join(f"{c}{d}{e}word" for c in "abcdefghij" for d in "klmnopqrst" for e in "abcdefghijklmnopqrstuvwxyz")
    assert len(toxicity.terms_of(common)) > 5_000
    rows = [(i, common + (" snarfle" if i % 2 and i < 20 else "")) for i in range(80)]
    rows = [(i, f"{text} n{i}") for i, text in rows]
    lexicon = toxicity.learn(docs_of(spark, rows), spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], LABELS))
    assert [e.rstrip("$") for e in lexicon.weights] == ["snarfle"]


def test_labelled_texts_without_words(spark):
    """Nothing to count in any task, in some tasks, or after the last part was sent."""
    learn = lambda rows, labels: toxicity.learn(docs_of(spark, rows).repartition(4), spark.createDataFrame(labels, LABELS))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    labels = [(i, 1, i % 2) for i in ids]
    assert learn([(i, None if i % 3 else "") for i in ids], labels).weights == {}
    assert learn([(i, "...!" * (1 + i)) for i in ids], labels).weights == {}
    assert learn([], labels).weights == {} and learn([(1, "a b")], []).weights == {}


def test_many_small_tasks_and_parts(spark, monkeypatch):
    rows, labels = corpus(random.Random(5), 300)
    marks = spark.createDataFrame(labels, LABELS)
    whole = toxicity.learn(docs_of(spark, rows), marks)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monkeypatch.setattr(toxicity, "HELD_TERMS", 3)  # every text is the last one of a part
        small = toxicity.learn(docs_of(spark, rows + [(9000 + i, "!?") for i in range(50)]).repartition(64),
                               spark.createDataFrame(labels + [(9000 + i, 1, 0) for i in range(50)], LABELS))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert small.weights.keys() == whole.weights.keys() and "grumbler fish" in small.exceptions


def test_scores_by_hand(spark):
    """A fixed lexicon over a few rows: the sum of weights, as it is and per hundred words, through the curve."""
    import math
    lexicon = toxicity.Lexicon({"clown$": 3.0, "idio": 2.0}, ["sad clown"], (-4.0, 1.0, 0.5))
    hand = {1: (0.0, 1), 2: (3.0, 2), 3: (5.0, 3), 4: (0.0, 2), 5: (0.0, 1)}  # weight, 1 + blanks and line ends
    docs = docs_of(spark, [(1, "hello"), (2, "CL0WN town"), (3, "idiotic the clown"), (4, "sad clown"), (5, None)])
    for r in toxicity.score(clashing(docs), lexicon).collect():
        weight, words = hand[r.doc_id]
        z = -4.0 + math.log1p(weight) + 0.5 * math.log1p(100 * weight / words)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-12 and r.predicted == int(r.score >= 0.3) and r._s == "mine" and r.judged == "mine"



def test_folding_of_words_with_digits_and_signs():
    """Against a plain rule: signs between letters, then every word that has both a letter and a digit."""
    import re
    import unicodedata
    rnd = random.Random(8)
    for _ in range(3000):
        text = "".join(rnd.choice("ab1203_ @$!|é²٣-.\n") for _ in range(rnd.randint(0, 20)))
        letter = lambda c: c.isalnum() and unicodedata.category(c) != "Nd"
        signs = "".join(toxicity.SIGNS[c] if c in toxicity.SIGNS and 0 < k < len(text) - 1 and letter(text[k - 1]) and text[k + 1].isalnum() else c for k, c in enumerate(text))
        want = re.sub(r"[^\W_]+", lambda m: m.group().translate(str.maketrans(toxicity.DIGITS)) if any(map(letter, m.group())) and re.search(r"\d", m.group()) else m.group(), signs)
        assert toxicity.fold(text) == want, text
