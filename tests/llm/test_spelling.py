import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.llm import spelling
from tests.llm.helpers import LONG_TEXT, clashing, docs_of


def plain_words(rows, least=5, count=3, slip=97):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1:] for k in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def words_of(spark, counts):
    return spark.createDataFrame(sorted(counts.items()) or [], "word string, n long")


def random_counts(seed, alphabet, lengths, size):
    rng = random.Random(seed)
    return {"".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))): rng.choice([3, 4, 6, 12, 30, 100]) for _ in range(size)}


@pytest.mark.parametrize("alphabet,lengths", [("ab", [1, 2, 3, 4, 5, 6]), ("abc", [5, 6]), ("aé", [4, 5, 9]), ("abcdefgh", [2, 3])])
def test_acceptor_accepts_each_pair_once(alphabet, lengths):
    words = sorted(random_counts(1, alphabet, lengths, 120))
    pairs = list(spelling.Acceptor(words).one_edit_pairs())
    found = [frozenset((words[i], words[j])) for i, j in pairs]
    assert len(found) == len(set(found))
    assert set(found) == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_acceptor_is_minimal():
    a = spelling.Acceptor(sorted(x + y for x in ("ab", "cd", "ef") for y in ("ing", "ings", "ed")))
    assert a.many[a.start] == 9
    languages = set()
    for s in range(len(a.states)):
        waiting, accepted = [(s, "")], []
        while waiting:
            p, w = waiting.pop()
            if a.states[p][0]:
                accepted.append(w)
            waiting += [(to, w + c) for c, (to, _) in a.states[p][1].items()]
        languages.add(frozenset(accepted))
    assert len(languages) == len(a.states)  # no two states accept the same


@pytest.mark.parametrize("group", [2, 10, 2048])
def test_variants_equal_brute_force(spark, group):
    counts = random_counts(5, "abc", [1, 2, 3, 4, 5, 6, 7], 300) | random_counts(6, "aé", [8, 9], 60)
    got = {tuple(r) for r in spelling.variants(words_of(spark, counts), group=group).collect()}
    assert got == plain_variants(counts)


def test_a_beginning_that_most_words_share(spark):
    """Hot states descend: the groups that tasks get stay small and no pair is lost."""
    counts = {"international" + w: n for w, n in random_counts(8, "abcd", [3, 4, 5], 400).items()}
    got = {tuple(r) for r in spelling.variants(words_of(spark, counts), group=16).collect()}
    assert got == plain_variants(counts)


def test_long_words_and_chains(spark):
    long = "abcdefgh" * 500
    counts = {long: 100, long[:-1]: 3, long[:2000] + "x" + long[2001:]: 10, "x" + long: 3, "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 24}
    got = {tuple(r) for r in spelling.variants(words_of(spark, counts)).collect()}
    assert got == plain_variants(counts)


def test_vocabulary_and_awkward_rows(spark):
    rng = random.Random(2)
    base = ["colour", "Colour", "color", "WORDS", "naïve", "Ärger", "straße", "tiny", "a1b2c3", "été", "x" * 400]
    rows = [(i, " ".join(rng.choice(base) for _ in range(30))) for i in range(300)]
    rows += [(7, None), (7, ""), (None, "alone alone alone"), (None, "alone"), (7, "123 ... 日本"), (900, LONG_TEXT), (901, "wörter" * 1), (901, "wörter"), (901, "wörter")]
    got = {r.word: r.n for r in spelling.vocabulary(clashing(docs_of(spark, rows))).collect()}
    assert got == plain_words(rows)
    assert spelling.vocabulary(docs_of(spark, [])).count() == 0
    assert spelling.vocabulary(docs_of(spark, [(1, None), (2, "12 !")])).count() == 0


def test_counts_that_leave_the_task_in_parts(spark, monkeypatch):
    """With a bound of three held words every text makes its own partial counts."""
    import sluice.llm.spelling as module
    monkeypatch.setattr(module, "HELD", 3)
    rows = [(i, "alpha bravo charlie delta foxtrot " * 2) for i in range(20)]
    assert {r.word: r.n for r in module.vocabulary(docs_of(spark, rows)).collect()} == plain_words(rows)


def test_empty_vocabulary(spark):
    got = spelling.variants(words_of(spark, {}))
    assert got.count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert [tuple(r) for r in spelling.variants(words_of(spark, {"alone": 5})).collect()] == [("alone", None, "alone", 5, 0, None)]


def test_no_task_holds_a_hot_state(spark):
    """Rows of a partition after descent, for a beginning shared by all words."""
    counts = {"prefix" + w: 3 for w in random_counts(9, "abcdefgh", [6], 1500)}
    rows = spelling.halved(words_of(spark, counts).select("word", "n", F.char_length("word").alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b")))
    first = spelling.partitioned(rows).groupBy("key").count().agg(F.max("count")).first()[0]
    second = spelling.partitioned(spelling.halved(rows)).groupBy("key").count().agg(F.max("count")).first()[0]
    assert first == len(counts) and second < 200
